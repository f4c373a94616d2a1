"""Case records: four input layouts, one normal form.

The layout is decided per record, so mixed files work. Each record is one JSON
value; everything happens inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions.text import blank, case_key, clean_exemplar_before, clean_java, clean_python
from changelens.operators.context import synthesized_diff

NO_FILES = f"cast(array() as {schemas.FILES})"
NO_EXEMPLARS = f"cast(array() as array<{schemas.EXEMPLAR}>)"


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Read a JSON array file (or JSON lines) of case records.

    An array file is one JSON document per file and so one task per file: give
    many files, or JSON lines, for large inputs.
    """
    raw = spark.read.schema(schemas.RAW_CASE).option("multiLine", not lines).json(path)
    return normalize(raw)


def parse_cases(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """Normalize a column of JSON texts, one record each."""
    parsed = df.select(*keep, F.from_json(json_col, schemas.RAW_CASE).alias("r")).select(*keep, "r.*")
    return normalize(parsed, *keep)


def _nonempty(*cols) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _text_or_files(name: str) -> tuple[Column, Column, Column]:
    """A field that is a string in one layout and a file array in another."""
    raw = F.col(name)
    is_array = F.coalesce(raw.startswith("["), F.lit(False))
    files = F.when(is_array, F.from_json(raw, schemas.FILES))
    single = F.when(blank(raw) | (raw == ""), F.expr(NO_FILES)).otherwise(
        F.array(F.struct(F.lit("unknown.py").alias("file"), raw.alias("code"))))
    return is_array, F.coalesce(files, F.expr(NO_FILES)), single


def normalize(raw: DataFrame, *keep: str) -> DataFrame:
    wrap = F.col("python_refactoring")
    fmt = (F.when(F.col("refactorings").isNotNull(), "new")
           .when(wrap.isNotNull(), "old")
           .when(F.col("refactoring_type").isNotNull() & F.col("matched_java_examples").isNotNull(), "flat")
           .when(F.col("refactoring_types").isNotNull() & F.col("commit_diff").isNotNull(), "commit")
           .otherwise("old"))
    is_array, before_files, before_single = _text_or_files("code_before")
    _, after_files, after_single = _text_or_files("code_after")
    # in the flat layout the type of the before field decides for both
    flat_before = F.when(is_array, before_files).otherwise(before_single)
    flat_after = F.when(is_array, after_files).when(
        F.coalesce(F.col("code_before"), F.lit("")) == "", F.expr(NO_FILES)).otherwise(
        F.array(F.struct(F.lit("unknown.py").alias("file"), F.coalesce("code_after", F.lit("")).alias("code"))))
    old = F.col("fmt") == "old"
    flat = F.col("fmt") == "flat"
    before = F.when(old, F.coalesce(wrap["code_before"], F.expr(NO_FILES))).when(flat, flat_before).otherwise(before_files)
    after = F.when(old, F.coalesce(wrap["code_after"], F.expr(NO_FILES))).when(flat, flat_after).otherwise(after_files)
    flat_text = F.concat_ws(
        "\n---\n", F.when(F.coalesce("code_before", F.lit("")) != "", F.concat(F.lit("BEFORE:\n"), "code_before")),
        F.when(F.coalesce("code_after", F.lit("")) != "", F.concat(F.lit("AFTER:\n"), "code_after")))
    built = F.when(flat & ~is_array, flat_text).otherwise(synthesized_diff("_before", "_after"))
    diff = F.coalesce(_nonempty(F.col("commit_diff"), F.when(old, wrap["commit_diff"])),
                      F.when(F.col("fmt") == "commit", F.lit("")).otherwise(built))
    one_type = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).when(
        c.startswith("["), F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(c))
    listed = F.transform(F.filter("refactorings", lambda r: F.coalesce(r["type"], F.lit("")) != ""), lambda r: r["type"])
    types = (F.when(F.col("fmt") == "new", listed).when(flat, one_type(F.col("refactoring_type")))
             .when(F.col("fmt") == "commit", F.col("refactoring_types"))
             .otherwise(F.coalesce(wrap["refactoring_types"], one_type(wrap["refactoring_type"]))))
    nested = F.flatten(F.transform("refactorings", lambda r: F.coalesce(r["matched_java_examples"], F.expr(NO_EXEMPLARS))))
    exemplars = (F.when(F.col("fmt") == "new", dedupe_exemplars(nested)).when(old, F.col("java_examples"))
                 .otherwise(F.col("matched_java_examples")))
    url = _nonempty(F.when(old, wrap["url"]).otherwise(F.col("url")))
    text = lambda c: F.when(old, F.lit("")).otherwise(F.coalesce(c, F.lit("")))
    staged = raw.withColumn("fmt", fmt).withColumn("_before", before).withColumn("_after", after)
    staged = staged.withColumn("_diff", diff)
    return staged.select(
        *keep, case_key(F.lit(None).cast("string"), url, F.col("_diff")).alias("case_id"),
        F.coalesce(url, F.lit("")).alias("url"), text(F.col("repository")).alias("repository"),
        text(F.col("sha1")).alias("sha1"), F.lit("").alias("commit_message"), types.alias("refactoring_types"),
        F.col("_diff").alias("commit_diff"), F.col("_before").alias("code_before"), F.col("_after").alias("code_after"),
        F.coalesce(exemplars, F.expr(NO_EXEMPLARS)).alias("java_examples"), "fmt")


def dedupe_exemplars(exemplars: Column) -> Column:
    """One exemplar per id (or type and description), the most similar one, in first-seen order."""
    key = lambda x: F.when(F.coalesce(x["id"], F.lit("")) != "", x["id"]).otherwise(
        F.concat_ws("_", F.coalesce(x["refactoring_type"], F.lit("")), F.coalesce(x["description"], F.lit(""))))
    sim = lambda x: F.coalesce(x["similarity"], F.lit(0.0))
    keys = F.array_distinct(F.transform(exemplars, key))
    best = lambda k: F.get(F.array_sort(F.transform(
        F.filter(exemplars, lambda x: key(x) == k), lambda x, i: F.struct((-sim(x)).alias("s"), i.alias("i"), x.alias("x")))), F.lit(0))["x"]
    return F.transform(keys, best)


def clean_cases(cases: DataFrame) -> DataFrame:
    """Shrink code fields; the diff stays as it is. Adds the character counts."""
    code = lambda c, f: F.transform(c, lambda x: x.withField("code", F.when(blank(x["code"]), x["code"]).otherwise(f(x["code"]))))
    shrink = F.transform("java_examples", lambda x: x.withField(
        "code_before", clean_exemplar_before(x["code_before"])).withField("code_after", clean_java(x["code_after"])))

    def chars(df: DataFrame) -> Column:
        n = lambda x: F.length(F.coalesce(x, F.lit("")))
        files = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + n(x["code"]))
        return files("code_before") + files("code_after") + F.aggregate(
            "java_examples", F.lit(0), lambda s, x: s + n(x["code_before"]) + n(x["code_after"]))

    out = cases.withColumn("chars_before", chars(cases))
    out = out.withColumn("code_before", code("code_before", clean_python)).withColumn(
        "code_after", code("code_after", clean_python)).withColumn("java_examples", shrink)
    return out.withColumn("chars_after", chars(out))


def char_totals() -> list[Column]:
    """Characters before and after cleaning, over all cases."""
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chars_before", "chars_after")]


def reduction(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(*char_totals()).withColumn("reduction_pct", F.when(
        F.col("chars_before") > 0, (1 - F.col("chars_after") / F.col("chars_before")) * 100).otherwise(F.lit(0.0)))


def one_per_case(cases: DataFrame) -> DataFrame:
    """One row per ``case_id``, the same on every run: the one with the smallest digest of its diff and labels."""
    order = F.md5(F.concat_ws("|", F.coalesce("commit_diff", F.lit("")), F.to_json("refactoring_types"), "url"))
    kept = cases.groupBy("case_id").agg(F.min_by(F.struct(*cases.columns), order).alias("_row"))
    return kept.select("_row.*")
