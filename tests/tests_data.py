CASE_SCHEMA = ("case_id string, url string, commit_diff string, code_before array<struct<file:string,code:string>>, "
               "code_after array<struct<file:string,code:string>>, refactoring_types array<string>")
DIFF = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -1,4 +1,4 @@
-    total = cost + tax
-    return total * rate
+    amount = cost + tax
+    return amount * rate
@@ -9 +9 @@
-    if x == y:
+    if x != y:
"""
