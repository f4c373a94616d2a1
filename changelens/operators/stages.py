"""The detection stages around an injected model.

Every stage is the same shape: build one request row per call, hand the rows to
the model function, parse the replies in the JVM, join them back on the case.
Replies are written to the checkpoint folder before they are used, so a lost
executor never makes the model answer the same request differently twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens import labels as L
from changelens import schemas
from changelens.config import EngineConfig
from changelens.functions import replies as P
from changelens.functions import text as X
from changelens.functions.diffs import context_window
from changelens.functions.rows import rows
from changelens.operators import context as C
from changelens.operators import filters, rules, setops
from changelens.operators import retrieval as R
from changelens.operators.signals import compute_signals, signal_tags, signals_xml
from changelens.operators.structure import SUMMARY, SUMMARY_TYPE, compute_facts, facts_summary, facts_xml
from changelens.plans.session import stored

ModelFn = Callable[[str, str, float], str]  # system text, user text, temperature -> reply
BATCH = 5
TEMPERATURES = [0.0, 0.2, 0.4, 0.6]
OWN_SHARE, RETRIEVED_SHARE = 0.65, 0.5  # fixed values: parts of the context for a case's own and for retrieved exemplars
_PAIRS = "array<struct<type:string,evidence:string>>"
_ROW = ["case_id", "ord", "type", "evidence", "confidence"]


@dataclass(frozen=True)
class Prompts:
    """System texts per stage; pass the wording your model was tuned for."""

    levels: str = "Name the levels a change touches, as <levels><level>...</level></levels>."
    detect: str = "List the labels of this level in <detected><defined/><undefined/></detected> with evidence."
    missing: str = "List labels that were missed in <additional/>, each with evidence."
    verify: str = "Confirm labels in <verified/>, each with confidence and evidence."
    challenge: str = "Answer KEEP or DROP with a reason, one line per detection."
    review: str = "Answer 'label | KEEP, DROP or UNCERTAIN | reason', one line per detection."
    definitions: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Knowledge:
    """What requests tell the model beside the case itself; every part may be left out.

    ``index`` and ``pool`` are the exemplars' vectors and records by ``id``: from them each label asked for gets ``k`` exemplars, nearest to the
    mean of the case's own ones. ``trophies`` is ``(case_id, trophies)``, successful cases by similarity, shown if the configuration says so.
    ``hint_tables`` holds mined hint tables by version, ``confusions`` the hint sentence of a label. With ``num_ctx``, the
    model's context in tokens, exemplars that the rest of a request leaves no room for are passed over.
    """

    index: DataFrame | None = None
    pool: DataFrame | None = None
    trophies: DataFrame | None = None
    hint_tables: dict = field(default_factory=dict)
    confusions: dict = field(default_factory=dict)
    k: int = 5
    dim: int = 64
    level_limit: int = 15
    num_ctx: int | None = None

    def budget(self, share: float) -> Column | None:
        """Characters for the exemplars of a case."""
        return None if self.num_ctx is None else C.char_budget(self.num_ctx, "code_diff", share)


@dataclass(frozen=True)
class Recorder:
    """A model whose calls are kept: ``calls`` holds (stage, answered requests)."""

    model: ModelFn
    calls: list = field(default_factory=list)

    def log(self) -> DataFrame:
        """``(case_id, stage, prompt, reply, error, duration_s, called_at)`` of every call."""
        out = None
        for stage, asked in self.calls:
            rows = asked.select("case_id", F.lit(stage).alias("stage"), "prompt", "reply", "error", "duration_s", "called_at")
            out = rows if out is None else out.union(rows)
        return out


def active_hints(cfg: EngineConfig, knowledge: Knowledge, hints: dict | None = None) -> dict | None:
    """The hint table of the configured version: None for the curated one. A version nobody gave is an error."""
    if hints is not None or cfg.hints_version in ("", "curated"):
        return hints
    if cfg.hints_version not in knowledge.hint_tables:
        raise ValueError(f"no hint table of version {cfg.hints_version!r}; given: {sorted(knowledge.hint_tables)}")
    return knowledge.hint_tables[cfg.hints_version]


def with_exemplars(cases: DataFrame) -> DataFrame:
    """The cases with ``java_examples``, null where the table has no such column."""
    return cases if "java_examples" in cases.columns else cases.withColumn("java_examples", F.lit(None).cast(f"array<{schemas.EXEMPLAR}>"))


def with_trophies(cases: DataFrame, cfg: EngineConfig, knowledge: Knowledge) -> DataFrame:
    """Add ``trophies_xml``, empty unless the configuration asks for successful cases."""
    if not cfg.use_trophies or knowledge.trophies is None:
        return cases.withColumn("trophies_xml", F.lit(""))
    shown = knowledge.trophies.select("case_id", C.trophies_xml("trophies").alias("trophies_xml"))
    return cases.join(shown, "case_id", "left").withColumn("trophies_xml", F.coalesce("trophies_xml", F.lit("")))


def with_retrieved(cases: DataFrame, targets: str, knowledge: Knowledge, out: str = "retrieved_xml") -> DataFrame:
    """Add the exemplars of the labels in ``targets``: by the case's own exemplars, or the first of each label where it has none."""
    if knowledge.index is None or knowledge.pool is None:
        return cases.withColumn(out, F.lit(""))
    some = with_exemplars(cases).where(F.size(targets) > 0).select("case_id", "code_diff", "java_examples", F.col(targets).alias("targets"))
    anchors = rows(some, R.anchor_ids("java_examples"), F.col("case_id").alias("query_id"), name="id")
    queries = stored(R.mean_pool_queries(knowledge.index, anchors, knowledge.dim).join(some.select(F.col("case_id").alias("query_id"), "targets"), "query_id"))
    near = R.retrieve_for_types(queries, knowledge.index, knowledge.k).select(F.col("query_id").alias("case_id"), "label", "row_id", "rank")
    none = some.join(queries.select(F.col("query_id").alias("case_id")), "case_id", "left_anti")
    first = R.without_query(rows(none, "targets", "case_id", name="label"), knowledge.index, knowledge.k).select("case_id", "label", "row_id", "rank")
    ids = near.union(first).join(knowledge.index.select("row_id", "id"), "row_id")
    found = R.hydrate(ids, knowledge.pool, "left").join(rows(some, "targets", "case_id", name="label").withColumn("ord", F.lit(0)).distinct(), ["case_id", "label"])
    at = F.array_position("targets", F.col("label"))
    one = F.struct(F.col("label").alias("for_type"), F.coalesce(F.col("refactoring_type"), F.col("label")).alias("refactoring_type"), "description", "code_text")
    lists = found.join(some.select("case_id", "targets", "code_diff"), "case_id").groupBy("case_id").agg(
        F.first("code_diff").alias("code_diff"),
        F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "rank", one.alias("x")))), lambda r: r["x"]).alias("_r"))
    shown = lists.select("case_id", C.retrieved_examples_xml("_r", knowledge.budget(RETRIEVED_SHARE)).alias(out))
    return cases.join(shown, "case_id", "left").withColumn(out, F.coalesce(out, F.lit("")))


def call_model(requests: DataFrame, model: ModelFn | Recorder, stage: str = "") -> DataFrame:
    """Answer ``(key columns, system, user, temperature)`` rows; adds reply, error, duration and time."""
    if isinstance(model, Recorder):
        asked = call_model(requests, model.model, stage)
        model.calls.append((stage, asked))
        return asked
    keys = [c for c in requests.columns if c not in ("system", "user", "temperature")]
    schema = requests.select(*keys).schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    added = "prompt string, reply string, error string, duration_s double, called_at timestamp"

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                start, reply, error = time.time(), "", None
                try:
                    reply = model(r.system, r.user, r.temperature)
                except Exception as exc:  # the injected function may raise anything
                    error = str(exc)[:500]
                out.append((reply, error, round(time.time() - start, 3), pd.Timestamp.fromtimestamp(start)))
            got = pd.DataFrame(out, columns=["reply", "error", "duration_s", "called_at"], index=pdf.index)
            yield pd.concat([pdf[keys], (pdf["system"] + "\n" + pdf["user"]).rename("prompt"), got], axis=1)

    return stored(requests.mapInPandas(run, f"{ddl}, {added}"))


def attach_facts(cases: DataFrame, cfg: EngineConfig, extractors: dict | None = None) -> DataFrame:
    """Add ``facts_xml``, ``facts`` and ``tags`` from the configured sources; unknown names are reported.

    ``facts`` sums up the fact rows of all sources together, as the request text shows them.

    ``extractors`` maps further source names to functions that yield member rows.
    """
    sources = [] if cfg.disable_facts else [s.strip() for s in cfg.facts_sources.lower().split("+") if s.strip()]
    books = {"ast": None, **(extractors or {})}
    out = cases.withColumn("facts", F.lit(None).cast(SUMMARY_TYPE)).withColumn("tags", F.lit(None).cast("array<string>"))
    blocks, every, unknown = [], None, [s for s in sources if s not in books and s != "intra"]
    for i, name in enumerate(s for s in sources if s not in unknown):
        if name == "intra":
            found = compute_signals(cases).select("case_id", signals_xml("signals").alias(f"_b{i}"), signal_tags("signals").alias("_tags"))
            out = out.join(found, "case_id", "left").withColumn(
                "tags", F.when(F.col(f"_b{i}") != "", F.col("_tags"))).drop("_tags")
        else:
            extractor = {} if books[name] is None else {"extractor": books[name]}
            facts = compute_facts(cases, cfg.gate_mode, **extractor)
            out = out.join(facts_xml(facts).withColumnRenamed("facts_xml", f"_b{i}"), "case_id", "left")
            every = facts if every is None else every.unionByName(facts)
        blocks.append(f"_b{i}")
    if every is not None:
        packed = facts_summary(every).select("case_id", F.struct(*SUMMARY).alias("_f"))
        out = out.join(packed, "case_id", "left").withColumn("facts", F.col("_f")).drop("_f")
    joined = F.concat_ws("\n\n", *[F.nullif(F.col(b), F.lit("")) for b in blocks])
    out = out.withColumn("facts_xml", joined).drop(*blocks)
    return out.withColumn("fact_errors", F.array(*[F.lit(f"unknown facts source: {u}") for u in unknown]).cast("array<string>"))


def _block(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


def _request(df: DataFrame, keys: list, system: Column, user: Column, cfg: EngineConfig, temperature=0.1) -> DataFrame:
    msgs = C.message_pair(system, user, cfg.suppress_thinking)
    return df.select(*keys, msgs[0]["content"].alias("system"), msgs[1]["content"].alias("user"),
                     (temperature if isinstance(temperature, Column) else F.lit(float(temperature))).alias("temperature"))


def classify_levels(cases: DataFrame, model: ModelFn, cfg: EngineConfig, prompts: Prompts) -> DataFrame:
    """Add ``levels``: what the model named, all levels if it named none."""
    asked = call_model(_request(cases, ["case_id"], F.lit(prompts.levels), X.diff_xml("code_diff"), cfg), model, "levels")
    every = F.array(*[F.lit(n) for n in L.LEVELS])
    got = asked.select("case_id", F.coalesce(P.parse_levels("reply"), every).alias("levels"))
    out = cases.join(got, "case_id", "left")
    levels = F.when(F.size("levels") > 0, F.col("levels")).otherwise(every)
    levels = F.array_distinct(F.transform(levels, F.lower))
    if cfg.skip_class_level:
        rest = F.filter(levels, lambda x: x != "class_level")
        levels = F.when(F.size(rest) > 0, rest).otherwise(F.array(F.lit("parameter_level"), F.lit("method_level")))
    return out.withColumn("levels", levels)


def detect(cases: DataFrame, model: ModelFn, cfg: EngineConfig, prompts: Prompts, knowledge: Knowledge = Knowledge()) -> DataFrame:
    """Add ``stage2_defined`` and ``stage2_undefined``: one call per level, repeated calls must agree.

    A request shows the case's own exemplars of its level, best first.
    """
    cases = with_exemplars(cases if "trophies_xml" in cases.columns else with_trophies(cases, cfg, knowledge))
    n = max(1, min(cfg.detect_calls, len(TEMPERATURES)))
    temps = F.array(*[F.lit(t) for t in (TEMPERATURES[:n] if n > 1 else [0.1])])
    calls = cases.select("case_id", "code_diff", "facts_xml", "trophies_xml", "java_examples", F.posexplode("levels").alias("lv_pos", "level")).select(
        "*", F.posexplode(temps).alias("call", "temp"))
    names = F.create_map(*[x for lv, ns in L.LEVELS.items() for x in (F.lit(lv), F.lit(", ".join(ns)))])
    shown = F.when(F.size("java_examples") > 0, C.level_examples_xml("java_examples", F.col("level"), knowledge.level_limit, knowledge.budget(OWN_SHARE)))
    user = _block(X.diff_xml("code_diff"), F.col("facts_xml"), F.col("trophies_xml"), F.coalesce(shown, F.lit("")),
                  F.concat(F.lit("Candidate types at this level: "), F.element_at(names, F.col("level"))))
    system = F.concat(F.lit(prompts.detect + "\nLevel: "), F.translate("level", "_", "-"))
    asked = call_model(_request(calls, ["case_id", "lv_pos", "call"], system, user, cfg, F.col("temp")), model, "detect")
    parsed = asked.select("case_id", "lv_pos", "call", P.parse_two_step("reply").alias("p"))
    rows = parsed.select("case_id", "call", "lv_pos", F.explode(F.array(
        F.struct(F.lit("defined").alias("kind"), F.col("p.defined").alias("items")),
        F.struct(F.lit("undefined").alias("kind"), F.col("p.undefined").alias("items")))).alias("k"))
    rows = rows.select("case_id", "call", "lv_pos", "k.kind", F.posexplode("k.items").alias("i", "x")).select(
        "case_id", "call", "kind", (F.shiftleft(F.col("lv_pos").cast("bigint"), 32) + F.col("i")).alias("ord"), "x.type", "x.evidence")
    once = setops.ordered_dedupe(rows, ["case_id", "call", "kind"], "type", "ord")
    if n > 1:
        once = setops.consensus(once, cases.select("case_id", F.lit(n).alias("n_calls")))
    pair = F.struct("ord", F.struct("type", "evidence").alias("x"))
    lists = once.groupBy("case_id").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, pair))), lambda r: r["x"]).alias(f"stage2_{k}")
        for k in ("defined", "undefined")])
    out = cases.join(lists, "case_id", "left")
    for k in ("stage2_defined", "stage2_undefined"):
        out = out.withColumn(k, F.coalesce(k, F.array().cast(_PAIRS)))
    return out


def _types(col: str) -> Column:
    return F.transform(col, lambda x: x["type"])


def find_missing(cases: DataFrame, model: ModelFn, cfg: EngineConfig, prompts: Prompts, history: DataFrame,
                 rule_rows: DataFrame, hints: dict | None = None, knowledge: Knowledge = Knowledge()) -> DataFrame:
    """Add ``stage3_targets`` and ``combined``: detections plus additions that pass the evidence gates.

    A request shows retrieved exemplars of every candidate.
    """
    hints = active_hints(cfg, knowledge, hints)
    if "trophies_xml" not in cases.columns:
        cases = with_trophies(cases, cfg, knowledge)
    allowed = L.PARAMETER_LEVEL + L.METHOD_LEVEL if cfg.skip_class_level else L.KNOWN_TYPES
    none = F.array().cast("array<string>")
    base = cases.withColumn("stage2_types", _types("stage2_defined"))
    targets = none if cfg.skip_missing else rules.missing_candidates("stage2_types", "levels", cfg, hints, cap=7)
    if cfg.skip_class_level:
        targets = F.array_intersect(targets, F.array(*[F.lit(a) for a in allowed]))
    base = base.withColumn("stage3_targets", targets)
    if cfg.precision_mode:
        low = filters.with_history(history.select("type"), history).where(F.col("hist_p") < cfg.precision_floor)
        bad = low.agg(F.collect_set("type").alias("_bad"))  # labels of the label space only
        base = base.withColumn("_bad", bad.scalar()).withColumn(
            "stage3_targets", F.array_except("stage3_targets", "_bad")).drop("_bad")
    base = with_retrieved(base, "stage3_targets", knowledge)
    user = _block(X.diff_xml("code_diff"), F.col("facts_xml"), F.col("trophies_xml"), X.detections_xml("stage2_detected", "stage2_defined"),
                  X.candidates_xml("stage3_targets"), F.col("retrieved_xml"))
    asked = call_model(_request(base.where(F.size("stage3_targets") > 0), ["case_id"], F.lit(prompts.missing), user, cfg), model, "missing")
    found = asked.select("case_id", P.parse_block(P.repair("reply"), "additional").alias("additions"))
    base = base.join(found, "case_id", "left")
    keys = F.transform("stage2_types", lambda t: F.lower(X.strip(t)))
    additions = F.filter(F.coalesce("additions", F.array().cast(_PAIRS)), lambda a: ~F.array_contains(keys, F.lower(X.strip(a["type"]))))
    if cfg.skip_class_level:
        additions = F.filter(additions, lambda a: a["type"].isin(allowed))
    base = base.withColumn("additions", additions)
    if cfg.precision_mode:
        base = _gate_additions(base, cfg, rule_rows)
    if cfg.detect_only:
        base = base.withColumn("additions", F.array().cast(_PAIRS))
    both = F.filter(F.concat("stage2_defined", "additions"), lambda x: X.strip(x["type"]) != "")
    return base.withColumn("combined", P.first_by_key(both, lambda x: F.lower(X.strip(x["type"]))))


def _gate_additions(base: DataFrame, cfg: EngineConfig, rule_rows: DataFrame) -> DataFrame:
    rows = base.select("case_id", F.array_sort("stage2_types").alias("labels"), "stage2_types", "facts", "tags",
                       F.posexplode("additions").alias("i", "a"))
    strengths = rules.rule_strengths(rows.select("labels"), rule_rows)
    rated = rows.withColumn("target", F.col("a.type")).join(strengths, ["labels", "target"], "left")
    reason = filters.addition_reason(
        F.col("a.type"), F.col("stage2_types"), F.coalesce("strength", F.lit(0.0)),
        F.coalesce("facts.kinds", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>")),
        cfg.rule_strength_tau, cfg.gate_mode)
    kept = rated.where(reason.isNull()).groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda x: x["a"]).alias("_kept"))
    return base.join(kept, "case_id", "left").withColumn("additions", F.coalesce("_kept", F.array().cast(_PAIRS))).drop("_kept")


def verify(cases: DataFrame, model: ModelFn, cfg: EngineConfig, prompts: Prompts, knowledge: Knowledge = Knowledge()) -> DataFrame:
    """One row per surviving detection: ``(case_id, ord, type, evidence, confidence)``.

    A request shows what the detected labels are confused with, and exemplars of these. If the reply names nothing, every detection so far stays, without confidence.
    """
    some = cases.where(F.size("combined") > 0)
    if "trophies_xml" not in some.columns:
        some = with_trophies(some, cfg, knowledge)
    some = with_retrieved(some.withColumn("_partners", rules.confusion_targets(_types("combined"))), "_partners", knowledge, "partners_xml")
    confused = C.confusion_hints_xml(_types("combined"), knowledge.confusions) if knowledge.confusions else F.lit("")
    user = _block(X.diff_xml("code_diff"), F.col("trophies_xml"), X.detections_xml("detections_so_far", "combined"), confused, F.col("partners_xml"))
    asked = call_model(_request(some, ["case_id"], F.lit(prompts.verify), user, cfg), model, "verify")
    text = P.repair("reply")
    got = asked.select("case_id", P.parse_block(text, "verified").alias("v"), P.parse_confidences(text).alias("conf"))
    both = some.select("case_id", "combined").join(got, "case_id", "left")
    fallback = F.transform("combined", lambda x: F.struct(x["type"].alias("type"), F.lit("").alias("evidence")))
    final = F.when(F.size("v") > 0, F.col("v")).otherwise(fallback)
    return both.select("case_id", "conf", F.posexplode(final).alias("ord", "x")).select(
        "case_id", "ord", "x.type", "x.evidence", F.try_element_at("conf", F.col("x.type")).alias("confidence"))


def challenge(detections: DataFrame, cases: DataFrame, model: ModelFn, cfg: EngineConfig, prompts: Prompts) -> DataFrame:
    """Question detections below the confidence threshold, five per call, verdicts by position.

    No confidence counts as certain; a missing verdict keeps. Certain detections come first.
    """
    sure = F.coalesce("confidence", F.lit(cfg.adversarial_threshold)) >= cfg.adversarial_threshold
    doubt = detections.where(~sure)
    w = Window.partitionBy("case_id").orderBy("ord")
    slots = doubt.withColumn("rn", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("rn") / BATCH)).withColumn(
        "slot", (F.col("rn") % BATCH).cast("int"))
    ctx = slots.join(cases.select("case_id", "code_diff", "facts_xml"), "case_id")
    book = F.create_map(*[F.lit(x) for p in prompts.definitions.items() for x in p]) if prompts.definitions else F.create_map().cast("map<string,string>")
    item = F.concat(
        F.lit("--- Detection ---\nType: "), "type", F.lit("\nDefinition: "),
        F.coalesce(F.try_element_at(book, F.col("type")), F.lit("a code-level change")), F.lit("\nEvidence: "),
        F.coalesce(F.nullif("evidence", F.lit("")), F.lit("(none)")), F.lit("\nDiff context:\n"), context_window("evidence", "code_diff"))
    batches = ctx.groupBy("case_id", "batch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", item.alias("t")))), lambda x: x["t"]), "\n").alias("items"),
        F.max("facts_xml").alias("facts_xml"))
    facts = F.col("facts_xml") if cfg.adversarial_with_facts else F.lit("")
    asked = call_model(_request(batches, ["case_id", "batch"], F.lit(prompts.challenge), _block(facts, F.col("items")), cfg), model, "challenge")
    verdicts = asked.select("case_id", "batch", F.posexplode(P.parse_keep_drop("reply")).alias("slot", "verdict"))
    return keep_certain_first(detections.where(sure), slots.drop("rn"), verdicts)


def keep_certain_first(certain: DataFrame, slots: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Certain detections, then the doubtful ones without a DROP verdict at their position."""
    judged = slots.join(verdicts, ["case_id", "batch", "slot"], "left")
    kept = judged.where(F.coalesce(F.upper("verdict").startswith("KEEP"), F.lit(True)))
    cols = ["case_id", "ord", "type", "evidence", "confidence"]
    merged = certain.select(*cols).unionByName(kept.select("case_id", (F.col("ord") + F.lit(1 << 60)).alias("ord"), "type", "evidence", "confidence"))
    return merged


def apply_review(detections: DataFrame, verdicts: DataFrame, floor: int = 70) -> DataFrame:
    """Final review: no verdict keeps, UNCERTAIN keeps from the confidence floor on (no confidence is 0)."""
    judged = detections.join(verdicts, ["case_id", "type"], "left")
    keep = (F.when(F.col("verdict").isNull() | (F.col("verdict") == "KEEP"), True).when(F.col("verdict") == "DROP", False)
            .otherwise(F.coalesce("confidence", F.lit(0)) >= floor))
    return judged.where(keep).select("case_id", "ord", "type", "evidence", "confidence")


def review(detections: DataFrame, cases: DataFrame, model: ModelFn, cfg: EngineConfig, prompts: Prompts) -> DataFrame:
    line = F.concat(F.lit("- "), "type", F.lit(" (confidence "), F.coalesce(F.col("confidence").cast("string"), F.lit("?")),
                    F.lit("): "), F.coalesce(F.nullif("evidence", F.lit("")), F.lit("(none)")))
    lists = detections.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("ord", line.alias("t")))), lambda x: x["t"]), "\n").alias("items"))
    full = lists.join(cases.select("case_id", "code_diff", "facts_xml"), "case_id")
    user = _block(F.col("code_diff"), F.coalesce(F.nullif("facts_xml", F.lit("")), F.lit("(no facts)")), F.col("items"))
    asked = call_model(_request(full, ["case_id"], F.lit(prompts.review), user, cfg), model, "review")
    return apply_review(detections, asked.select("case_id", F.explode(P.parse_review("reply")).alias("type", "verdict")), cfg.review_floor)


def run_stages(cases: DataFrame, model: ModelFn, cfg: EngineConfig, prompts: Prompts | None = None,
               history: DataFrame | None = None, rule_rows: DataFrame | None = None, hints: dict | None = None,
               with_retrieval: bool = True, extractors: dict | None = None, knowledge: Knowledge | None = None) -> DataFrame:
    """All stages: adds ``final_types`` (sorted known labels, then unknown ones) and the stage outputs.

    Give a ``Recorder`` as the model to keep all prompts and replies, for ``logs.case_trace``.
    """
    spark, prompts, knowledge = cases.sparkSession, prompts or Prompts(), knowledge or Knowledge()
    active_hints(cfg, knowledge, hints)
    history = history if history is not None else spark.createDataFrame([], "type string, support bigint, precision double")
    rule_rows = rule_rows if rule_rows is not None else spark.createDataFrame([], "antecedent string, consequent string, score double")
    base = cases.withColumn("code_diff", C.format_case("commit_diff", "code_before", "code_after"))
    base = with_trophies(attach_facts(base, cfg, extractors), cfg, knowledge)
    base = detect(classify_levels(base, model, cfg, prompts), model, cfg, prompts, knowledge)
    if with_retrieval:
        base = find_missing(base, model, cfg, prompts, history, rule_rows, hints, knowledge)
        rows = verify(base, model, cfg, prompts, knowledge)
        if cfg.precision_mode:
            rows = filters.confidence_gate(rows, history, cfg.hard_block_precision, cfg.confidence_threshold).where(
                "reason is null").select(*_ROW)
            if cfg.struct_gates:
                joined = rows.join(base.select("case_id", "code_diff", "facts", "tags"), "case_id")
                rows = joined.where(filters.structural_gate("type", "evidence", "code_diff", "facts", "tags", cfg.gate_mode)).select(*_ROW)
        if cfg.citation_check:
            joined = rows.join(base.select("case_id", "code_diff"), "case_id")
            rows = filters.citation(joined, "evidence", "code_diff", cfg.citation_overlap).where("keep").select(*_ROW)
        if cfg.adversarial:
            rows = challenge(rows, base, model, cfg, prompts)
        if cfg.evidence_review:
            rows = review(rows, base, model, cfg, prompts)
        known = rows.groupBy("case_id").agg(F.collect_set("type").alias("verified"))
    else:
        known = base.select("case_id", _types("stage2_defined").alias("verified"))
    out = base.join(known, "case_id", "left").withColumn("verified", F.coalesce("verified", F.array().cast("array<string>")))
    unknown = F.col("stage2_undefined")
    if cfg.precision_mode:
        text = F.array_distinct(X.identifiers("code_diff"))
        def cited(u: Column) -> Column:
            ids = F.array_distinct(X.identifiers(u["evidence"]))
            return F.coalesce(F.size(F.array_intersect(ids, text)) / F.nullif(F.size(ids), F.lit(0)) >= cfg.unknown_overlap, F.lit(False))
        unknown = F.filter(unknown, cited)
    final = F.concat(F.array_sort(setops.collapse_compounds("verified")), F.transform(unknown, lambda u: u["type"]))
    return out.withColumn("final_types", final)
