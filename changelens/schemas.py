"""Explicit schemas: no inference pass over the input."""

FILES = "array<struct<file:string,code:string>>"

EXEMPLAR = (
    "struct<id:string,refactoring_type:string,similarity:double,rerank_score:double,"
    "description:string,code_text:string,code_before:string,code_after:string,"
    "code_element_type:string,code_element:string,repository:string,url:string,"
    "type_match:boolean>"
)

CASES = (
    "case_id string, url string, repository string, sha1 string, commit_message string, "
    f"refactoring_types array<string>, commit_diff string, code_before {FILES}, "
    f"code_after {FILES}, java_examples array<{EXEMPLAR}>, fmt string"
)

# Superset of the four input layouts. ``code_before`` and ``refactoring_type`` are
# a string in some layouts and an array in others, so they are read as raw JSON text.
RAW_CASE = (
    "url string, repository string, sha1 string, commit_diff string, "
    "code_before string, code_after string, refactoring_type string, "
    "refactoring_types array<string>, "
    f"refactorings array<struct<type:string,matched_java_examples:array<{EXEMPLAR}>>>, "
    f"matched_java_examples array<{EXEMPLAR}>, java_examples array<{EXEMPLAR}>, "
    f"python_refactoring struct<code_before:{FILES},code_after:{FILES},commit_diff:string,"
    "refactoring_types:array<string>,refactoring_type:string,url:string>"
)

EXEMPLAR_INDEX = "row_id bigint, id string, label string, embedding array<float>"
DETECTIONS = (
    "case_id string, stage string, ord int, type string, evidence string, confidence int"
)
RESULT_LOG = (
    "case_id string, scheduled_for_type string, round_robin_index bigint, url string, "
    "ground_truth_known array<string>, final_types array<string>, final_known array<string>, "
    "final_undefined array<string>, tp int, fp int, fn int, fatal_error string"
)
FAILURE_LOG = (
    "source string, file string, error string, error_type string, sha1 string, ts timestamp"
)
