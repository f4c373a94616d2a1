"""Multi-label scoring.

Predictions and truth meet inside the case row as arrays, so a case never leaves
its task; only counters per track or per type are exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens import labels as L
from changelens.functions.rows import rows as unnest
from changelens.functions.text import _c, is_known_type, normalize_type


def _set(col) -> Column:
    return F.array_distinct(F.coalesce(_c(col), F.array().cast("array<string>")))


def _known(col) -> Column:
    return F.filter(_set(col), is_known_type)


def label_sets(predicted, truth, mode: str = "normalized") -> tuple[Column, Column]:
    """The two sets to compare.

    ``normalized``: both sides restricted to known labels, compared ignoring case and blanks.
    ``exact``: as written, predictions without the unknown-type entries, truth untouched.
    ``whitelist``: as written, both sides restricted to the exact known labels.
    """
    if mode == "normalized":
        return _known(predicted), _known(truth)
    if mode == "exact":
        return F.filter(_set(predicted), lambda t: ~t.startswith("UnknownType")), _set(truth)
    if mode == "whitelist":
        names = F.array(*[F.lit(n) for n in L.KNOWN_TYPES])
        return F.array_intersect(_set(predicted), names), F.array_intersect(_set(truth), names)
    raise ValueError(f"unknown mode {mode!r}")


def case_metrics(df: DataFrame, predicted: str, truth: str, mode: str = "normalized") -> DataFrame:
    """Add ``tp fp fn matched missed false_alarms`` per case."""
    pred, gt = label_sets(predicted, truth, mode)
    out = df.withColumn("_p", pred).withColumn("_g", gt)
    key = normalize_type if mode == "normalized" else (lambda x: x)
    out = out.withColumn("_pk", F.transform("_p", key)).withColumn("_gk", F.transform("_g", key))
    shared = lambda own, other: (lambda _t, i: F.array_contains(other, F.get(own, i)))
    absent = lambda own, other: (lambda _t, i: ~F.array_contains(other, F.get(own, i)))
    out = out.withColumn("matched", F.filter("_p", shared("_pk", "_gk")))
    out = out.withColumn("missed", F.filter("_g", absent("_gk", "_pk")))
    out = out.withColumn("false_alarms", F.filter("_p", absent("_pk", "_gk")))
    return (out.withColumn("tp", F.size("matched")).withColumn("fp", F.size("false_alarms"))
            .withColumn("fn", F.size("missed")).drop("_p", "_g", "_pk", "_gk"))


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def with_rates(df: DataFrame) -> DataFrame:
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = df.withColumn("p", p).withColumn("r", r)
    return out.withColumn("f1", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def micro(scored: DataFrame, *by: str) -> DataFrame:
    """Micro totals. Rows marked ERROR add only their misses, SKIPPED rows nothing."""
    live = scored if "status" in scored.columns else scored.withColumn("status", F.lit(None).cast("string"))
    status = F.coalesce("status", F.lit("OK"))
    ok = status.isin("SKIPPED", "ERROR")
    return with_rates(live.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(status == "SKIPPED").alias("skipped"),
        F.sum(F.when(~ok, F.col("tp")).otherwise(0)).alias("tp"),
        F.sum(F.when(~ok, F.col("fp")).otherwise(0)).alias("fp"),
        F.sum(F.when(status != "SKIPPED", F.col("fn")).otherwise(0)).alias("fn")))


def type_counts(df: DataFrame, predicted: str, truth: str, *by: str, mode: str = "whitelist") -> DataFrame:
    """``tp fp fn`` per type (and group) from one pass over the label arrays."""
    pred, gt = label_sets(predicted, truth, mode)
    key = normalize_type if mode == "normalized" else (lambda x: x)
    both = df.select(*by, F.array_distinct(F.transform(pred, key)).alias("p"),
                     F.array_distinct(F.transform(gt, key)).alias("g"))
    rows = unnest(both, F.array_union("p", "g"), *by, "p", "g", name="type")
    in_p, in_g = F.array_contains("p", F.col("type")), F.array_contains("g", F.col("type"))
    return rows.groupBy(*by, "type").agg(
        F.count_if(in_p & in_g).alias("tp"), F.count_if(in_p & ~in_g).alias("fp"),
        F.count_if(in_g & ~in_p).alias("fn"))


def per_type(df: DataFrame, predicted: str, truth: str, mode: str = "normalized") -> DataFrame:
    """Confusion counts and rates of every type that occurs; ``tn`` follows from the case count."""
    live = df
    if "status" in df.columns:
        live = df.where(~F.coalesce("status", F.lit("OK")).isin("SKIPPED", "ERROR"))
    n = live.agg(F.count("*").alias("n_cases"))
    counts = type_counts(live, predicted, truth, mode=mode).withColumn("n_cases", n.scalar())
    full = with_rates(counts.withColumn("tn", F.col("n_cases") - F.col("tp") - F.col("fp") - F.col("fn")))
    full = full.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("n_cases")))
    return full.select("type", "tp", "fp", "fn", "tn", *[
        F.round(c, 4).alias(a) for c, a in (("p", "precision"), ("r", "recall"), ("accuracy", "accuracy"), ("f1", "f1"))])


def macro_accuracy(per_type_rows: DataFrame) -> DataFrame:
    return per_type_rows.agg(F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("macro_accuracy"))


def undefined_counts(df: DataFrame, predicted: str) -> DataFrame:
    """Predicted labels outside the label space, most frequent first."""
    unknown = unnest(df, F.filter(_c(predicted), lambda t: ~is_known_type(t)), name="type")
    return unknown.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def error_rows(df: DataFrame, truth: str) -> DataFrame:
    """Score of a failed case: nothing predicted, every known truth label missed."""
    known = _known(truth)
    return df.select("*", F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.size(known).alias("fn"), known.alias("missed"))


def track_scores(df: DataFrame, predicted: str, truth: str, track: str = "track") -> DataFrame:
    return micro(case_metrics(df, predicted, truth, "whitelist"), track)


def paired_cases(df: DataFrame, live: list[str] | None = None, track: str = "track") -> DataFrame:
    """Cases present in every live track, for all tracks.

    The number of live tracks that hold a case decides; tracks that stopped early
    are scored on the same cases but do not shrink them.
    """
    is_live = F.lit(True) if live is None else F.col(track).isin(live)
    n_live = df.where(is_live).agg(F.count_distinct(track).alias("n_live"))
    # one row per (case, track) before counting, so a repeated case costs nothing extra
    seen = df.where(is_live).select("case_id", track).distinct()
    common = seen.groupBy("case_id").agg(F.count("*").alias("n")).where(
        F.col("n") == n_live.scalar()).select("case_id")
    return df.join(common, "case_id", "left_semi")


def shared_track_scores(df: DataFrame, predicted: str, truth: str, live: list[str] | None = None, track: str = "track") -> DataFrame:
    """``track_scores`` over the cases of ``paired_cases``: cases are scored and paired in one grouping of counters."""
    is_live = F.lit(True) if live is None else F.col(track).isin(live)
    n_live = df.where(is_live).agg(F.count_distinct(track).alias("n_live"))  # reads the track column only
    scored = case_metrics(df, predicted, truth, "whitelist")
    kept = [track, *(["status"] if "status" in df.columns else []), "tp", "fp", "fn"]
    per_case = scored.groupBy("case_id").agg(
        F.collect_set(F.when(is_live, F.col(track))).alias("_seen"), F.collect_list(F.struct(*kept)).alias("_rows"))
    return micro(per_case.where(F.size("_seen") == n_live.scalar()).select(F.inline("_rows")), track)


def deltas(scores: DataFrame, base: str, track: str = "track") -> DataFrame:
    """Rate differences of every track against one of them (one row per track, so one window over all of them)."""
    b = F.max(F.when(F.col(track) == base, F.struct("p", "r", "f1"))).over(Window.partitionBy(F.lit(0)))
    rated = scores.withColumn("b", b).where((F.col(track) != base) & F.col("b").isNotNull())
    return rated.select(track, *[(F.col(c) - F.col("b")[c]).alias("d_" + c) for c in ("p", "r", "f1")])


def best_track(scores: DataFrame, metric: str, track: str = "track", order: str | None = None) -> DataFrame:
    """Track with the largest metric; the earliest wins a tie."""
    pos = F.col(order or track)
    return scores.orderBy(F.desc(metric), pos.asc()).limit(1).select(F.col(track), F.col(metric))


def type_report(counts: DataFrame, *by: str, types: list[str] = L.KNOWN_TYPES) -> DataFrame:
    """Every known type per group with rates to four places, best first; unseen types are zero."""
    grid = counts.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(t) for t in types])).alias("type"))
    full = grid.join(counts, [*by, "type"], "left").na.fill(0, ["tp", "fp", "fn"])
    rated = with_rates(full).select(*by, "type", "tp", "fp", "fn", *[
        F.round(c, 4).alias(a) for c, a in (("p", "precision"), ("r", "recall"), ("f1", "f1"))])
    return rated.orderBy(*by, F.desc("f1"), F.desc("tp"), "type")
