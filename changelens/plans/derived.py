"""Code-change records derived from the order table.

The driver tables hold no commits, so each order row is written out as one: the
texts below vary with its status, priority, customer and price. Every text is
one SQL expression that Spark and the oracle both evaluate, row by row, so the
records grow with the table and nothing is exchanged to make them.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tpl(text: str) -> str:
    """A text with ``{sql}`` holes as a SQL ``concat`` expression."""
    parts = []
    for literal, hole, _, _ in Formatter().parse(text):
        for i, line in enumerate(literal.split("\n")):
            if i:
                parts.append("chr(10)")
            if line:
                parts.append(f"'{line}'")
        if hole:
            parts.append(hole)
    return f"concat({', '.join(parts)}, '')"


def when(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN {tpl(text)} ELSE '' END"


PRIO = "substr(o_orderpriority, 1, 1)"
OLD, NEW = f"concat('qty', {PRIO})", "concat('amount', o_custkey)"
FILLED, OPEN, URGENT = "o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderpriority < '3'"
CHEAP, MID, DEAR = "o_totalprice < 150000", "o_totalprice >= 250000", "o_totalprice >= 350000"

URL = tpl("https://git.example.org/team/repo{o_custkey}/commit/{o_orderkey}")

DIFF = f"""concat({tpl(
    "diff --git a/pkg/{" + OLD + "}.py b/pkg/{" + OLD + "}.py\n--- a/pkg/{" + OLD + "}.py\n+++ b/pkg/{" + OLD + "}.py\n"
    "@@ -1,3 +1,3 @@ def price\n def price(cost, tax, rate):\n"
    "-    {" + OLD + "} = cost + tax\n-    return {" + OLD + "} * rate\n"
    "+    {" + NEW + "} = cost + tax\n+    return {" + NEW + "} * rate\n")}, {when(DEAR,
    "@@ -9,2 +9,2 @@\n-    log({" + OLD + "}, 1)\n-    send({" + OLD + "})\n+    log(other, 1)\n+    send(other)\n")}, {when(FILLED,
    "@@ -20 +20 @@\n-    if x == y:\n+    if x != y:\n         stop()\n")}, {when(OPEN,
    "@@ -20 +20 @@\n-    while ready and open_now:\n+    while not ready and open_now:\n")}, {when(URGENT,
    "@@ -30,2 +30,3 @@\n-    if paid and count > {o_custkey}:\n-        ship()\n"
    "+    if paid:\n+        if count > {o_custkey}:\n+            ship()\n")}, {when(MID,
    "@@ -40,2 +40,2 @@\n-    count = count + 1\n-    print(count)\n+    self.count = self.count + 1\n+    print(self.count)\n")}, {when(CHEAP,
    "@@ -50 +50 @@\n-    level: int = 0\n+    level: float = 0\n")}, {when(OPEN,
    "diff --git a/net.py b/net.py\n--- a/net.py\n+++ b/net.py\n@@ -1,3 +1,3 @@\n"
    "+    host = cfg.get(" + '"host")\n-    send(cfg.get("host"), 1)\n+    send(host, 1)\n-    log(cfg.get("host"))\n+    log(host)\n')}, {when(FILLED,
    "diff --git a/net.py b/net.py\n--- a/net.py\n+++ b/net.py\n@@ -1,3 +1,2 @@\n"
    "-    port = cfg.port_number\n-    open_it(port)\n-    close_it(port)\n+    open_it(cfg.port_number)\n+    close_it(cfg.port_number)\n")})"""

HELPER = "\ndef helper(path):\n    return path.join(path.base, path.name)\n"
BEFORE_MAIN = tpl(
    "class Order{" + PRIO + "}(Base):\n    rate: int = 1\n\n    def total(self, x):\n        self.{" + OLD + "} = x\n        return x\n"
    "\n    def audit(self):\n        return sum(range(100)) + len(self.trail)\n")
AFTER_MAIN = f"""concat({tpl("class Order{" + PRIO + "}")}, {when(OPEN, "(Base, Mixin)")}, {when(f"NOT ({OPEN})", "(Base)")}, {tpl(
    ":\n    rate: int = 1\n\n    def total(self, x")}, {when(URGENT, ", taxed")}, {tpl(
    "):\n        self.{" + NEW + "} = x\n        return x\n")}, {when(f"NOT ({DEAR})",
    "\n    def audit(self):\n        return sum(range(100)) + len(self.trail)\n")}, {when(DEAR,
    "\nclass Auditor:\n    def audit(self):\n        return sum(range(100)) + len(self.trail)\n")})"""
UTIL_AFTER = f"CASE WHEN {FILLED} THEN 'pkg/helpers.py' ELSE 'pkg/util.py' END"

REPLY = f"""concat({tpl(
    '<think>maybe <defined><type evidence="+x">Move Class</type></defined></think><detected><defined>'
    '<type evidence="+    {' + NEW + '} = cost + tax">Rename Variable</type>')}, {when(FILLED,
    '<type evidence="-    if x == y:"Invert Condition</type>')}, {when(URGENT,
    '<type evidence="+    if paid:">rename variable</type><type evidence="+    if count &gt; 1:"> Split Conditional </type>')}, '</defined>', {when(
    MID, '<undefined><type evidence="+print(self.count)">UnknownType: counter &amp; state</type></undefined>')}, {when(
    f"NOT ({MID})", '<undefined/>')}, '</detected>')"""
VERIFIED = f"""concat('<verified>', {tpl(
    '<type confidence="{' + PRIO + '}5" evidence="+a">Rename Variable</type>')}, {when(OPEN,
    '<type evidence="+    self.count">Replace Variable With Attribute</type>')}, {when(FILLED,
    '<type confidence="90" evidence="-    if x == y:">Invert Condition</type><type confidence="40" evidence="+b">Rename Variable</type>')}, '</verified>')"""

# (label, condition): truth labels and the labels each run predicts
TRUTH = [
    ("Rename Variable", "o_totalprice < 350000"), ("Invert Condition", f"NOT ({URGENT}) OR {FILLED}"),
    ("Split Conditional", URGENT), ("Replace Variable With Attribute", MID), ("Change Variable Type", CHEAP),
    ("Extract Variable", OPEN), ("Change Return Type", "o_totalprice >= 450000"),
]
RUNS = {
    "base": [("Rename Variable", "o_totalprice < 400000"), ("Invert Condition", FILLED), ("Split Conditional", "o_orderpriority < '4'"),
             ("Extract Variable", MID), ("UnknownType: counter", MID), ("Change Return Type", DEAR)],
    "gated": [("rename  variable", "o_totalprice < 300000"), ("Invert Condition", f"{FILLED} OR {OPEN}"), ("Split Conditional", URGENT),
              ("Change Variable Type", CHEAP), ("Replace Variable With Attribute", DEAR)],
    "checked": [("Rename Variable", "o_totalprice < 350000"), ("Invert Condition", FILLED), ("Split Conditional", URGENT),
                ("Extract Variable", OPEN), ("Pull Up Method", DEAR)],
}
RUN_CASES = {"base": "1 = 1", "gated": "o_orderstatus <> 'P'", "checked": "o_orderpriority <> '5-LOW'"}


def spark_labels(pairs) -> str:
    return "array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in pairs) + "))"


def duck_labels(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in pairs) + "], lambda x: x IS NOT NULL)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ROWS_A_TASK = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table of few splits, and at most ROWS_A_TASK rows in a task.

    The rows are small here and grow into long texts later, so a split of a usual
    size holds millions of them. A table that has enough splits is left as it is.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"))
    return orders.select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.expr(URL).alias("url"),
        F.expr(DIFF).alias("commit_diff"), F.expr(spark_labels(TRUTH)).alias("refactoring_types"),
        F.array(F.struct(F.lit("pkg/main.py").alias("file"), F.expr(BEFORE_MAIN).alias("code")),
                F.struct(F.lit("pkg/util.py").alias("file"), F.expr(tpl(HELPER)).alias("code"))).alias("code_before"),
        F.array(F.struct(F.lit("pkg/main.py").alias("file"), F.expr(AFTER_MAIN).alias("code")),
                F.struct(F.expr(UTIL_AFTER).alias("file"), F.expr(tpl(HELPER)).alias("code"))).alias("code_after"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.expr(REPLY).alias("reply"), F.expr(VERIFIED).alias("verified"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(case_id, track, predicted, truth)``: one row per case and run that covers it."""
    orders = spread(table(spark, sf_dir, "orders"))
    per_run = F.array(*[
        F.struct(F.lit(name).alias("track"), F.expr(f"({RUN_CASES[name]})").alias("covered"),
                 F.expr(spark_labels(pairs)).alias("predicted")) for name, pairs in RUNS.items()])
    rows = orders.select(F.col("o_orderkey").cast("string").alias("case_id"),
                         F.expr(spark_labels(TRUTH)).alias("truth"), F.explode(per_run).alias("r"))
    return rows.where("r.covered").select("case_id", "r.track", "r.predicted", "truth")


# Oracle side

DUCK_CASES = f"cases AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, {URL} AS url, {DIFF} AS commit_diff, o_orderstatus, o_orderpriority, o_totalprice, o_custkey, o_orderkey FROM orders)"
DUCK_REPLIES = f"replies AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, {REPLY} AS reply, {VERIFIED} AS verified FROM orders)"
DUCK_RUNS = "runs AS (" + " UNION ALL ".join(
    f"SELECT CAST(o_orderkey AS VARCHAR) AS case_id, '{name}' AS track, {duck_labels(pairs)} AS predicted, {duck_labels(TRUTH)} AS truth "
    f"FROM orders WHERE {RUN_CASES[name]}" for name, pairs in RUNS.items()) + ")"

# lines of every hunk, then edited line pairs, by windows over the exploded text
DUCK_LINES = DUCK_CASES + r""",
raw AS (SELECT case_id, unnest(string_split(commit_diff, chr(10))) AS ln,
               generate_subscripts(string_split(commit_diff, chr(10)), 1) AS pos FROM cases),
flag AS (SELECT *, ln LIKE 'diff --git a/%' AS is_git, ln LIKE '--- %' AS is_old, ln LIKE '@@ %' AS is_at
         FROM raw WHERE ln <> '' AND ln NOT LIKE '+++%'),
st AS (SELECT *, sum(CASE WHEN is_git OR is_old OR is_at THEN 1 ELSE 0 END) OVER w AS hunk,
              last_value(CASE WHEN is_git THEN regexp_extract(ln, ' b/(\S+)$', 1)
                              WHEN is_old THEN regexp_extract(ln, '^--- (?:a/)?(\S+)', 1) END IGNORE NULLS) OVER w AS file,
              last_value(CASE WHEN is_git THEN 0 WHEN is_old OR is_at THEN 1 END IGNORE NULLS) OVER w AS in_hunk
       FROM flag WINDOW w AS (PARTITION BY case_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
body AS (SELECT case_id, hunk, file, pos,
                CASE WHEN left(ln, 1) IN ('+', '-', ' ') THEN left(ln, 1) ELSE ' ' END AS sign,
                CASE WHEN left(ln, 1) IN ('+', '-', ' ') THEN substr(ln, 2) ELSE ln END AS line
         FROM st WHERE in_hunk = 1 AND NOT (is_git OR is_old OR is_at))"""
DUCK_PAIRS = DUCK_LINES + """,
edges AS (SELECT *, CASE WHEN lag(sign) OVER w IS DISTINCT FROM sign THEN 1 ELSE 0 END AS fresh
          FROM body WINDOW w AS (PARTITION BY case_id, hunk ORDER BY pos)),
runs_of AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id, hunk ORDER BY pos) AS run FROM edges),
numbered AS (SELECT *, row_number() OVER (PARTITION BY case_id, hunk, run ORDER BY pos) AS i FROM runs_of),
pairs AS (SELECT m.case_id, m.hunk, m.pos, m.line AS before, p.line AS after
          FROM numbered m JOIN numbered p ON m.case_id = p.case_id AND m.hunk = p.hunk AND p.run = m.run + 1 AND p.i = m.i
          WHERE m.sign = '-' AND p.sign = '+')"""
