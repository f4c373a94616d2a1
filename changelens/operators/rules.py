"""Co-occurrence rules between labels, and candidate labels derived from them.

Cases with the same label set are counted once: the set is the grouping key, and
everything after that works on distinct sets of a small label dictionary. Label
pairs are formed inside one set, never across the cases of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens import labels as L
from changelens.config import EngineConfig, cap_steps
from changelens.functions.rows import let, rows
from changelens.functions.text import _c
from changelens.plans.session import stored


def label_sets(labelled: DataFrame, key: str = "case_id", label: str = "label") -> DataFrame:
    """Distinct label sets with the number of cases that have them: ``(labels, n)``."""
    per_case = labelled.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return per_case.groupBy("labels").agg(F.count("*").alias("n"))


def _subsets(labels, size: int) -> Column:
    """Sorted subsets of one label set, as arrays."""
    arr = _c(labels)
    out = F.transform(arr, lambda x: F.array(x))
    for _ in range(size - 1):
        out = F.flatten(F.transform(out, lambda s: F.transform(
            F.filter(arr, lambda y: y > F.element_at(s, -1)), lambda y: F.array_append(s, y))))
    return out


def itemset_counts(sets: DataFrame, size: int) -> DataFrame:
    items = rows(sets, _subsets("labels", size), "n", name="items")
    return items.groupBy("items").agg(F.sum("n").alias("n"))


def frequent_sets(sets: DataFrame, min_count: int) -> DataFrame:
    """The sets without labels that fewer than ``min_count`` cases have; no itemset of that support holds one."""
    if min_count <= 1:
        return sets
    items = rows(sets, "labels", "labels", "n", name="label")
    often = items.groupBy("label").agg(F.sum("n").alias("_c")).where(F.col("_c") >= min_count).select("label")
    cut = items.join(often, "label").groupBy("labels", "n").agg(F.array_sort(F.collect_list("label")).alias("_l"))
    return cut.groupBy(F.col("_l").alias("labels")).agg(F.sum("n").alias("n"))


def frequent_itemsets(sets: DataFrame, min_count: int, size: int = 3) -> dict[int, DataFrame]:
    """``(items, n)`` of the label sets of 1 to ``size`` labels, level by level; those of the last level reach ``min_count`` or are left out.

    A row is a label set, a prefix found in it and the labels that may follow. A level hands each row to its
    next labels, one row each, so a set of many labels is never one long value of subsets. From level 3 on
    only labels follow that make a candidate: the prefix and the label join two frequent prefixes,
    and all other subsets are frequent too.
    """
    base = frequent_sets(sets, min_count)
    step = base.select("n", F.lit(None).cast("array<string>").alias("items"), F.col("labels").alias("tail"))
    out: dict[int, DataFrame] = {}
    for k in range(1, size + 1):
        if k > 2 and min_count > 1:
            often = stored(out[k - 1].where(F.col("n") >= min_count).select("items"))
            out[k - 1] = out[k - 1].where(F.col("n") >= min_count)
            last = F.element_at("items", -1)
            ends = often.select(F.slice("items", 1, k - 2).alias("_p"), last.alias("_e"))
            joined = often.withColumn("_p", F.slice("items", 1, k - 2)).join(ends, "_p").where(F.col("_e") > last).drop("_p")
            for drop in range(k - 2):
                other = F.concat(F.slice("items", 1, drop), F.slice("items", drop + 2, k), F.array("_e"))
                joined = joined.withColumn("_s", other).join(often.select(F.col("items").alias("_s")), "_s", "left_semi").drop("_s")
            follow = joined.groupBy("items").agg(F.collect_set("_e").alias("_f"))  # of the label dictionary
            step = step.join(follow, "items").select("n", "items", F.array_intersect("tail", "_f").alias("tail"))
        deal = step.select("n", "items", "tail", F.posexplode_outer("tail").alias("_i", "_x")).where(F.col("_x").isNotNull())
        items = F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array("_x"))
        step = deal.select("n", items.alias("items"), F.slice("tail", F.col("_i") + 2, F.size("tail") + 1).alias("tail"))
        out[k] = step.groupBy("items").agg(F.sum("n").alias("n"))
    return out


def pair_stats(sets: DataFrame) -> DataFrame:
    """Support, confidence, lift and NPMI of every label pair in both directions."""
    total = sets.agg(F.sum("n").alias("n_cases"))
    single = itemset_counts(sets, 1).select(F.col("items")[0].alias("l"), "n")
    pairs = itemset_counts(sets, 2)
    directed = pairs.select(F.col("n").alias("n_ab"), F.explode(F.array(
        F.struct(F.col("items")[0].alias("a"), F.col("items")[1].alias("b")),
        F.struct(F.col("items")[1].alias("a"), F.col("items")[0].alias("b")))).alias("d")).select("d.*", "n_ab")
    full = (directed.join(single.select(F.col("l").alias("a"), F.col("n").alias("n_a")), "a")
            .join(single.select(F.col("l").alias("b"), F.col("n").alias("n_b")), "b").withColumn("n_cases", total.scalar()))
    n, ab, a, b = (F.col(c).cast("double") for c in ("n_cases", "n_ab", "n_a", "n_b"))
    pmi = F.ln(ab * n / (a * b))
    return full.select("a", "b", "n_ab", "n_a", "n_b", (ab / n).alias("support"), (ab / a).alias("confidence"),
                       (ab * n / (a * b)).alias("lift"),
                       F.when(ab < n, pmi / -F.ln(ab / n)).otherwise(F.lit(1.0)).alias("npmi"))


def mine_hints(stats: DataFrame, by: str = "n_ab", top: int = 4) -> DataFrame:
    """Ordered partners per label: by count, by NPMI, or by lift times confidence (``score``)."""
    scored = stats.withColumn("score", F.round(F.col("lift") * F.col("confidence"), 9)).withColumn("npmi", F.round("npmi", 9))
    w = Window.partitionBy("a").orderBy(F.desc(by), F.asc("b"))
    return scored.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= top).select(
        F.col("a").alias("src"), "ord", F.col("b").alias("dst"))


def association_rules(sets: DataFrame, min_count: int = 1) -> DataFrame:
    """Rules with one or two labels on the left: ``(antecedent, consequent, confidence, lift, score)``.

    ``antecedent`` is the sorted labels joined by ``|``; ``score`` is lift times confidence.
    Itemsets are counted level by level, and only candidates whose parts reach ``min_count`` are formed.
    """
    total = sets.agg(F.sum("n").alias("n_cases"))
    counts = frequent_itemsets(sets, min_count)
    single = counts[1].select(F.col("items")[0].alias("consequent"), F.col("n").alias("n_c"))
    out = None
    for k in (1, 2):
        left = counts[k].select(F.array_join("items", "|").alias("antecedent"), F.col("n").alias("n_x"))
        joint = counts[k + 1].where(F.col("n") >= min_count).select(
            F.explode(F.transform("items", lambda c: F.struct(
                F.array_join(F.array_remove("items", c), "|").alias("antecedent"), c.alias("consequent")))).alias("r"),
            F.col("n").alias("n_xc")).select("r.*", "n_xc")
        part = joint.join(left, "antecedent").join(single, "consequent").withColumn("n_cases", total.scalar())
        out = part if out is None else out.unionByName(part)
    n_xc, n_x, n_c, n = (F.col(c).cast("double") for c in ("n_xc", "n_x", "n_c", "n_cases"))
    conf, lift = n_xc / n_x, n_xc * n / (n_x * n_c)
    return out.select("antecedent", "consequent", "n_xc", conf.alias("confidence"), lift.alias("lift"), (lift * conf).alias("score"))


def rule_strengths(sets: DataFrame, rules: DataFrame, labels: str = "labels") -> DataFrame:
    """Strongest rule towards every label from each label set: ``(labels, target, strength)``.

    Labels no rule reaches are absent; read them as 0.
    """
    keys = rows(sets.select(labels).distinct(), F.transform(
        F.concat(_subsets(F.array_sort(labels), 1), _subsets(F.array_sort(labels), 2)),
        lambda s: F.array_join(s, "|")), labels, name="antecedent")
    hit = keys.join(rules.select("antecedent", F.col("consequent").alias("target"), "score"), "antecedent")
    return hit.groupBy(labels, "target").agg(F.max("score").alias("strength"))


# Candidates

def voted_by_edges(df: DataFrame, edges: DataFrame, cap: int | None, key: str = "case_id", detected: str = "labels",
                   always: list[str] | None = None) -> DataFrame:
    """``(key, candidates)`` like ``vote_candidates``, for a hint table ``(src, ord, dst)`` of any size.

    Detected labels meet the edges in a join; only labels and votes are exchanged.
    """
    empty = F.array().cast("array<string>")
    votes = rows(df, detected, key, name="src").join(edges.select("src", "dst"), "src").groupBy(key, "dst").agg(F.count("*").alias("n"))
    ranked = votes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_votes"), "dst"))).alias("_r"))
    found = F.coalesce(F.transform("_r", lambda r: r["dst"]), empty)
    backup = F.array(*[F.lit(a) for a in (always or [])]).cast("array<string>")
    both = F.array_except(F.array_union(found, backup), F.coalesce(F.col(detected), empty))
    out = df.select(key, detected).join(ranked, key, "left")
    return out.select(key, (both if cap is None else F.slice(both, 1, cap)).alias("candidates"))


def hint_map(hints: dict[str, list[str]]) -> Column:
    none = F.create_map().cast("map<string,array<string>>")
    return F.create_map(*[
        x for src, dst in hints.items() for x in (F.lit(src), F.array(*[F.lit(d) for d in dst]).cast("array<string>"))
    ]) if hints else none


def vote_candidates(detected, hints: dict[str, list[str]], cap: int | Column | None = 7, hybrid: dict | None = None,
                    always: list[str] | None = None) -> Column:
    """Labels hinted at by the detected ones, most votes first, then the backup list, cut to ``cap``.

    Votes are counted inside the row.
    """
    found = _c(detected)
    empty = F.array().cast("array<string>")
    books = [hint_map(h) for h in (hints, hybrid) if h]
    votes = F.flatten(F.transform(found, lambda t: F.concat(empty, *[F.coalesce(F.try_element_at(b, t), empty) for b in books])))
    open_votes = F.filter(votes, lambda c: ~F.array_contains(found, c))
    ranked = let(open_votes, lambda vs: F.array_sort(F.transform(F.array_distinct(vs), lambda c: F.struct(
        (F.size(F.array_remove(vs, c)) - F.size(vs)).alias("minus_votes"), c.alias("label")))))
    backup = F.array_except(F.array(*[F.lit(a) for a in (always or [])]).cast("array<string>"), found)
    both = F.array_union(F.transform(ranked, lambda r: r["label"]), backup)
    return both if cap is None else F.slice(both, F.lit(1), cap if isinstance(cap, Column) else F.lit(cap))


def level_types(levels) -> Column:
    """All labels of the given levels, in order: the fallback when nothing was detected."""
    book = F.create_map(*[x for lv, names in L.LEVELS.items() for x in (F.lit(lv), F.array(*[F.lit(n) for n in names]))])
    return F.array_distinct(F.flatten(F.transform(_c(levels), lambda lv: F.coalesce(
        F.try_element_at(book, lv), F.array().cast("array<string>")))))


def missing_candidates(detected, levels, cfg: EngineConfig, hints: dict[str, list[str]] | None = None,
                       cap: int | None = None) -> Column:
    """Candidate labels of a case under the configured hint table, hybrid, backup and cap rules."""
    active = L.CURATED_HINTS if hints is None else hints
    hybrid = L.CURATED_HINTS if cfg.hints_hybrid and hints is not None else None
    limit: int | Column = cap if cap is not None else cfg.missing_cap
    if cap is None and cfg.adaptive_cap:
        limit = F.coalesce(*[F.when(F.lit(True) if most is None else F.size(_c(detected)) <= most, n) for most, n in cap_steps(cfg.missing_cap)])
    voted = vote_candidates(detected, active, limit, hybrid, [] if cfg.drop_always_check else L.ALWAYS_CHECK)
    return F.when(F.size(_c(detected)) > 0, voted).otherwise(level_types(levels))


def scored_candidates(strengths: DataFrame, sets: DataFrame, types: DataFrame, level_priors: DataFrame,
                      global_priors: DataFrame, alpha: float, beta: float, gamma: float, cap: int) -> DataFrame:
    """Rank open labels of each set by ``alpha * rule + beta * level prior + gamma * prior``.

    ``level_priors`` is already reduced to the best prior per label. Ties go to the
    label that sorts last.
    """
    book = types.agg(F.collect_set("type").alias("book"))  # the label dictionary
    grid = rows(sets.select("labels").distinct().withColumn("book", book.scalar()),
                F.array_except("book", "labels"), "labels", name="target")
    full = (grid.join(strengths, ["labels", "target"], "left")
            .join(level_priors.select(F.col("type").alias("target"), F.col("prior").alias("p_level")), "target", "left")
            .join(global_priors.select(F.col("type").alias("target"), F.col("prior").alias("p_all")), "target", "left")
            .na.fill(0.0, ["strength", "p_level", "p_all"]))
    scored = full.withColumn("score", F.round(
        alpha * F.col("strength") + beta * F.col("p_level") + gamma * F.col("p_all"), 9)).where("score > 0")
    w = Window.partitionBy("labels").orderBy(F.desc("score"), F.desc("target"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("labels", "target", "score", "rank")


# Lookups

def confusion_targets(detected, cap: int = 6) -> Column:
    """Detected labels with a confusion hint, and the compounds when a part of one was detected."""
    found = _c(detected)
    own = F.array_intersect(found, F.array(*[F.lit(t) for t in L.CONFUSABLE]))
    triggered = F.arrays_overlap(found, F.array(*[F.lit(t) for t in L.COMPOUND_TRIGGERS]))
    more = F.when(triggered, F.array(*[F.lit(c) for c in L.COMPOUNDS])).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_sort(F.array_union(own, more)), 1, cap)


def combined_hints(label, hints: dict[str, list[str]] | None = None, cap: int = 7) -> Column:
    """Curated then mined partners of one label, distinct, cut to ``cap``."""
    empty = F.array().cast("array<string>")
    books = [L.CURATED_HINTS] + ([hints] if hints else [])
    return F.slice(F.array_distinct(F.concat(*[
        F.coalesce(F.try_element_at(hint_map(b), _c(label)), empty) for b in books])), 1, cap)


def lookup(df: DataFrame, name: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``found_key`` and ``value``: exact match first, then ignoring case and repeated blanks."""
    fold = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    exact = table.select(F.col(key).alias(name), F.col(key).alias("_k1"), F.col(value).alias("_v1"))
    loose = table.groupBy(fold(F.col(key)).alias("_n")).agg(
        F.max(F.col(key)).alias("_k2"), F.max_by(F.col(value), F.col(key)).alias("_v2"))
    out = df.join(exact, name, "left").withColumn("_n", fold(F.col(name))).join(loose, "_n", "left")
    return out.withColumn("found_key", F.coalesce("_k1", "_k2")).withColumn(
        value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2", "_n")
