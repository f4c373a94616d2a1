"""The append log of finished cases: writing, and reading it back to resume."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens import schemas
from changelens.config import EngineConfig
from changelens.operators import context
from changelens.sources.paths import exists


def read_log(spark: SparkSession, path: str, schema: str = schemas.RESULT_LOG) -> DataFrame:
    """JSON lines, those in the folders of batches too; blank and broken lines are left out, a missing log is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def finished_cases(log: DataFrame) -> DataFrame:
    return log.where(F.coalesce("case_id", F.lit("")) != "").select("case_id").distinct()


def finished_per_type(log: DataFrame) -> DataFrame:
    return log.where(F.coalesce("scheduled_for_type", F.lit("")) != "").groupBy(
        F.col("scheduled_for_type").alias("type")).agg(F.count("*").alias("n"))


def read_tracks(spark: SparkSession, root: str, tracks: list[str]) -> DataFrame:
    """Logs of several runs with their track name; tracks without a log are skipped."""
    found = [(t, os.path.join(root, t)) for t in tracks if exists(spark, os.path.join(root, t))]
    parts = [read_log(spark, p).withColumn("track", F.lit(t)) for t, p in found]
    if not parts:
        return spark.createDataFrame([], schemas.RESULT_LOG + ", track string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def case_record(df: DataFrame, predicted: str = "final_types", truth: str = "refactoring_types") -> DataFrame:
    """Result log rows: predictions split into known and unknown labels, exact set scores."""
    known = F.filter(predicted, lambda t: ~t.startswith("UnknownType"))
    unknown = F.filter(predicted, lambda t: t.startswith("UnknownType"))
    p, g = F.array_distinct(known), F.array_distinct(truth)
    extra = {"scheduled_for_type": "string", "round_robin_index": "bigint", "fatal_error": "string"}
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast(extra[c]).alias(c)
    return df.select(
        "case_id", col("scheduled_for_type"), col("round_robin_index"), "url", F.col(truth).alias("ground_truth_known"),
        F.col(predicted).alias("final_types"), known.alias("final_known"), unknown.alias("final_undefined"),
        F.size(F.array_intersect(p, g)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"),
        F.size(F.array_except(g, p)).alias("fn"), col("fatal_error"))


def case_trace(df: DataFrame, calls: DataFrame | None, cfg: EngineConfig, predicted: str = "final_types", truth: str = "refactoring_types") -> DataFrame:
    """The whole trace of every case: its record, the output of each stage, sizes of what requests showed, errors, and all model calls.

    ``df`` is what ``stages.run_stages`` returns, ``calls`` the log of its ``Recorder``. Calls meet their case in a grouping by case; a case
    without a call keeps an empty list.
    """
    one = F.struct("called_at", "stage", "prompt", F.col("reply").alias("response_raw"), "duration_s", "error")
    said = None if calls is None else calls.groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("llm_calls"))
    rows = df if said is None else df.join(said, "case_id", "left")
    if said is None:
        rows = rows.withColumn("llm_calls", F.lit(None).cast("array<struct<called_at:timestamp,stage:string,prompt:string,response_raw:string,duration_s:double,error:string>>"))
    rows = rows.withColumn("llm_calls", F.coalesce("llm_calls", F.array().cast(rows.schema["llm_calls"].dataType)))
    have = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c)
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit(0)
    pairs = "array<struct<type:string,evidence:string>>"
    failed = F.transform(F.filter("llm_calls", lambda c: c["error"].isNotNull()), lambda c: F.concat(c["stage"], F.lit(": "), c["error"]))
    noted = F.col("fact_errors") if "fact_errors" in df.columns else F.array().cast("array<string>")
    replies = lambda stage: F.transform(F.filter("llm_calls", lambda c: c["stage"] == stage), lambda c: c["response_raw"])
    ends = F.transform("llm_calls", lambda c: F.unix_micros(c["called_at"]) / 1e6 + c["duration_s"])
    record = case_record(df, predicted, truth)
    more = rows.select(
        "case_id", context.case_summary(df).alias("python_commit"),
        context.summarize_exemplars(F.col("java_examples") if "java_examples" in df.columns else F.lit(None).cast(f"array<{schemas.EXEMPLAR}>")).alias("java_examples_used"),
        have("levels", "array<string>").alias("stage1_output"), have("stage2_defined", pairs), have("stage2_undefined", pairs),
        have("stage3_targets", "array<string>"), have("additions", pairs).alias("stage3_output"), have("combined", pairs).alias("stage4_targets"),
        have("verified", "array<string>").alias("stage4_output"), size("facts_xml").alias("structural_facts_chars"),
        F.lit(None if cfg.disable_facts else cfg.facts_sources).alias("structural_facts_source"), size("trophies_xml").alias("trophies_chars"),
        F.lit(cfg.precision_mode).alias("precision_mode"), F.concat(noted, failed).alias("errors"),
        F.struct(*[replies(x).alias(x) for x in ("levels", "detect", "missing", "verify", "challenge", "review")]).alias("stage_raw"),
        "llm_calls", F.size("llm_calls").alias("n_llm_calls"), F.array_min(F.transform("llm_calls", lambda c: c["called_at"])).alias("started_at"),
        F.timestamp_micros((F.array_max(ends) * 1e6).cast("bigint")).alias("ended_at"))
    wall = F.round(F.unix_micros("ended_at") / 1e6 - F.unix_micros("started_at") / 1e6, 2)
    return record.join(more, "case_id").withColumn("wall_clock_total_s", F.coalesce(wall, F.lit(0.0)))


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_batch(records: DataFrame, path: str) -> None:
    """The rows of one batch of a stream in a folder of its own; a repeated batch replaces it."""
    records.write.mode("overwrite").json(path)


def write_failures(failures: DataFrame, path: str) -> None:
    failures.write.mode("append").json(path)


def write_type_report(report: DataFrame, path: str) -> None:
    """One small CSV per track; the report has one row per label of the label space."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_evaluation(summary: DataFrame, details: DataFrame, path: str, stamp: str) -> None:
    summary.write.mode("overwrite").json(f"{path}/evaluation_{stamp}")
    details.write.mode("overwrite").json(f"{path}/detailed_results_{stamp}")


def markdown_table(df: DataFrame, columns: list[str]) -> str:
    """Render a small result (one row per track or label) as a Markdown table."""
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join(head + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in df.select(*columns).collect()])


def evaluation_text(totals: DataFrame, per_type: DataFrame, undefined: DataFrame, top: int = 10) -> str:
    """Totals of one run, its labels that occur, and its most frequent labels outside the label space.

    ``totals`` is one row of ``scoring.micro``, ``per_type`` comes from ``scoring.per_type``, ``undefined`` from
    ``scoring.undefined_counts``; only label rows and ``top`` unknown ones are read.
    """
    seen = per_type.where(F.col("tp") + F.col("fp") + F.col("fn") > 0).orderBy("type")
    all_unknown = undefined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("detections"), F.count("*").alias("labels"))
    return "\n\n".join([
        "## Known labels", markdown_table(totals, ["n", "skipped", "tp", "fp", "fn", "p", "r", "f1"]),
        "## By label", markdown_table(seen, ["type", "tp", "fp", "fn", "precision", "recall", "f1"]),
        "## Unknown labels", markdown_table(all_unknown, ["detections", "labels"]),
        markdown_table(undefined.orderBy(F.desc("n"), "type").limit(top), ["type", "n"])]) + "\n"


def headline(tracks: DataFrame, paired: DataFrame, changes: DataFrame) -> str:
    """Per-track scores, scores on the shared cases, and differences to the base track."""
    rates = ["n", "tp", "fp", "fn", "p", "r", "f1"]
    return "\n\n".join([
        "## Per track", markdown_table(tracks, ["track", *rates]),
        "## Shared cases", markdown_table(paired, ["track", *rates]),
        "## Differences", markdown_table(changes, ["track", "d_p", "d_r", "d_f1"])]) + "\n"
