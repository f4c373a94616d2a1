"""Command line: ``spark-submit -m``-style entry for cleaning, scheduling and scoring.

    python -m changelens.cli clean    --input cases.json --output cleaned
    python -m changelens.cli schedule --input cases.json --log results --per-type 30 --output todo
    python -m changelens.cli score    --root runs --tracks base gated --base base --output report
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from changelens.functions.rows import rows
from changelens.operators import filters, sampling, scoring
from changelens.plans.session import ship
from changelens.sources import cases, logs


def clean(spark: SparkSession, a) -> str:
    cleaned = cases.clean_cases(cases.read_cases(spark, a.input, a.lines))
    totals = Observation("chars")  # summed while the cleaned cases are written
    cleaned.observe(totals, *cases.char_totals()).drop("chars_before", "chars_after").write.mode("overwrite").json(a.output)
    before, after = totals.get["chars_before"], totals.get["chars_after"]
    return f"code chars: {before} -> {after} ({(1 - after / before) * 100 if before else 0.0:.1f}% reduction)"


def schedule(spark: SparkSession, a) -> str:
    """Open cases in round-robin order, after the size filters and without finished cases."""
    found = filters.within_token_budget(cases.read_cases(spark, a.input, a.lines), a.max_tokens)
    if a.known_only:
        found = filters.known_labels_only(found)
    if a.type_avg_filter > 0:
        found = filters.within_type_size(found, a.type_avg_filter)
    log = logs.read_log(spark, a.log) if a.log else None
    done = logs.finished_cases(log) if log is not None else None
    counts = logs.finished_per_type(log) if log is not None else None
    labelled = rows(found, "refactoring_types", "case_id", name="type")
    order = sampling.round_robin(labelled, a.per_type, done, counts)
    if a.max_examples:
        order = order.where(F.col("round_robin_index") < a.max_examples)
    todo = order.withColumnRenamed("type", "scheduled_for_type").join(cases.one_per_case(found), "case_id")
    todo.write.mode("overwrite").json(a.output)
    return f"scheduled {order.count()} cases"


def score(spark: SparkSession, a) -> str:
    """Per-track and shared-case scores as Markdown, and one label report per track as CSV."""
    log = logs.read_tracks(spark, a.root, a.tracks)
    live = [t for t in a.tracks if t not in a.stopped]
    both = ("final_known", "ground_truth_known")
    shared = scoring.shared_track_scores(log, *both, live)
    text = logs.headline(scoring.track_scores(log, *both), shared, scoring.deltas(shared, a.base))
    logs.write_type_report(scoring.type_report(scoring.type_counts(log, *both, "track"), "track"), os.path.join(a.output, "per_type"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(a.output, "headline"))
    return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="changelens")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("clean", "schedule"):
        c = sub.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--lines", action="store_true", help="input is JSON lines")
    s = sub.choices["schedule"]
    s.add_argument("--log", default=None, help="result log of earlier runs to continue")
    s.add_argument("--per-type", type=int, default=30)
    s.add_argument("--max-tokens", type=int, default=131072)
    s.add_argument("--type-avg-filter", type=float, default=0.0)
    s.add_argument("--max-examples", type=int, default=None)
    s.add_argument("--known-only", action="store_true")
    c = sub.add_parser("score")
    c.add_argument("--root", required=True)
    c.add_argument("--tracks", nargs="+", required=True)
    c.add_argument("--stopped", nargs="*", default=[], help="tracks that stopped early")
    c.add_argument("--base", required=True)
    for c in sub.choices.values():
        c.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("changelens").getOrCreate()
    ship(session)
    print({"clean": clean, "schedule": schedule, "score": score}[a.command](session, a))


if __name__ == "__main__":
    main()
