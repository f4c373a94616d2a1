"""Texts and messages for the model, assembled inside the case row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens import labels as L
from changelens.functions import text as X
from changelens.functions.text import _c

OVERHEAD_CHARS = 12000


def format_case(diff, before, after) -> Column:
    """The change as one text: the diff if there is one, else the files side by side."""
    b, a = _c(before), _c(after)
    pairs = F.slice(F.arrays_zip(b.alias("b"), a.alias("a")), F.lit(1), F.greatest(F.least(F.size(b), F.size(a)), F.lit(0)))
    part = lambda p: F.concat(
        F.lit("### File: "), F.coalesce(p["b"]["file"], F.lit("unknown.py")), F.lit("\n\n**Before:**\n```python\n"),
        F.coalesce(p["b"]["code"], F.lit("")), F.lit("\n```\n\n**After:**\n```python\n"),
        F.coalesce(p["a"]["code"], F.lit("")), F.lit("\n```\n"))
    head = "## Python Code Changes\n\n"
    files = F.concat(F.lit(head), F.array_join(F.transform(pairs, part), "\n"))
    both = (F.coalesce(F.size(b), F.lit(0)) > 0) & (F.coalesce(F.size(a), F.lit(0)) > 0)
    return (F.when(~X.blank(diff), F.concat(F.lit("## Python Commit Diff\n\n```diff\n"), _c(diff), F.lit("\n```")))
            .when(both, files).otherwise(F.lit(head + "N/A")))


def synthesized_diff(before, after) -> Column:
    """Diff text built from the files when the record has none."""
    b, a = _c(before), _c(after)
    pairs = F.slice(F.arrays_zip(b.alias("b"), a.alias("a")), F.lit(1), F.greatest(F.least(F.size(b), F.size(a)), F.lit(0)))
    part = lambda p: F.concat(
        F.lit("=== "), F.coalesce(p["b"]["file"], F.lit("unknown.py")), F.lit(" ===\nBEFORE:\n"),
        F.coalesce(p["b"]["code"], F.lit("")), F.lit("\nAFTER:\n"), F.coalesce(p["a"]["code"], F.lit("")), F.lit("\n---"))
    return F.coalesce(F.array_join(F.transform(pairs, part), "\n"), F.lit(""))


def case_summary(cases: DataFrame) -> Column:
    """The five fields that tell a case apart, empty where the case has none."""
    texts = [F.coalesce(F.col(c), F.lit("")) if c in cases.columns else F.lit("") for c in ("url", "repository", "sha1", "commit_diff")]
    labels = F.coalesce(F.col("refactoring_types"), F.array().cast("array<string>"))
    return F.struct(texts[0].alias("url"), texts[1].alias("repository"), texts[2].alias("sha1"), labels.alias("refactoring_types"), texts[3].alias("commit_diff"))


def summarize_exemplars(exemplars, limit: int = 20, chars: int = 1500) -> Column:
    return F.transform(F.slice(_c(exemplars), 1, limit), lambda x: F.struct(
        x["id"].alias("id"), x["refactoring_type"].alias("refactoring_type"), x["similarity"].alias("similarity"),
        x["rerank_score"].alias("rerank_score"), x["url"].alias("url"),
        X.truncate(x["code_text"], chars).alias("code_text_truncated")))


# Ordering and budgets

def rank_exemplars(exemplars, limit: int) -> Column:
    """Best first by rerank score, else similarity; equal scores keep their order."""
    score = lambda x: F.coalesce(x["rerank_score"], x["similarity"], F.lit(0.0))
    ordered = F.array_sort(F.transform(_c(exemplars), lambda x, i: F.struct(
        (-score(x)).alias("s"), i.alias("i"), x.alias("x"))))
    return F.slice(F.transform(ordered, lambda r: r["x"]), 1, limit)


def best_first(df: DataFrame, by: list[str], limit: int, tie: str) -> DataFrame:
    """The same order over rows: the best ``limit`` rows per group.

    The rank filter limits each task's rows per group before the exchange.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(F.coalesce("rerank_score", "similarity", F.lit(0.0))), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def fit_budget(items, size, budget) -> Column:
    """Take items in order while they fit; one that does not fit is skipped and later ones may still fit.

    The fold carries the used size and the kept positions of a list that was
    already cut to a few items.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("keep"))
    sizes = F.transform(_c(items), lambda x: size(x).cast("bigint"))
    numbered = F.transform(sizes, lambda s, i: F.struct(s.alias("s"), i.cast("int").alias("i")))
    limit = _c(budget) if isinstance(budget, (str, Column)) else F.lit(budget)

    def take(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["s"] <= limit
        return F.struct(F.when(fits, acc["used"] + x["s"]).otherwise(acc["used"]).alias("used"),
                        F.when(fits, F.array_append(acc["keep"], x["i"])).otherwise(acc["keep"]).alias("keep"))

    keep = F.aggregate(numbered, start, take)["keep"]
    return F.transform(keep, lambda i: F.get(_c(items), i))


def char_budget(num_ctx, diff, share: float) -> Column:
    """Characters left for exemplars after the diff and the fixed overhead."""
    n = num_ctx if isinstance(num_ctx, Column) else F.lit(num_ctx)
    return F.greatest(F.lit(0), F.floor(n * 4 * share) - F.length(_c(diff)) - OVERHEAD_CHARS)


def _example(tag_indent: str, x: Column, code: Column) -> Column:
    desc = X.xml_escape(x["description"])
    return F.concat(
        F.lit(f'{tag_indent}<example type="'), X.xml_escape(F.coalesce(x["refactoring_type"], F.lit("Unknown"))), F.lit('">\n'),
        F.when(desc != "", F.concat(F.lit(f"{tag_indent}  <description>"), desc, F.lit("</description>\n"))).otherwise(""),
        F.when(code != "", F.concat(F.lit(f"{tag_indent}  <code_text>"), X.xml_escape(code), F.lit("</code_text>\n"))).otherwise(""),
        F.lit(f"{tag_indent}</example>"))


def level_types(level: Column) -> Column:
    """The labels of a level; none for an unknown one."""
    book = F.create_map(*[x for lv, names in L.LEVELS.items() for x in (F.lit(lv), F.array(*[F.lit(n) for n in names]))])
    return F.coalesce(F.try_element_at(book, level), F.array().cast("array<string>"))


def _code(x: Column) -> Column:
    return X.exemplar_text(x["code_text"], x["code_before"], x["code_after"])


def level_examples_xml(exemplars, level: str | Column, limit: int = 15, budget=None) -> Column:
    """Exemplars of one level (a name or a column of names), best first, within the character budget."""
    names = level_types(level if isinstance(level, Column) else F.lit(level))
    mine = rank_exemplars(F.filter(_c(exemplars), lambda x: F.array_contains(names, x["refactoring_type"])), limit)
    coded = F.transform(mine, lambda x: F.struct(x.alias("x"), _code(x).alias("code")))
    if budget is not None:
        coded = fit_budget(coded, lambda e: F.length(e["code"]) + F.length(F.coalesce(e["x"]["description"], F.lit(""))), budget)
    return X.xml_list("java_reference_examples", F.transform(coded, lambda e: _example("  ", e["x"], e["code"])))


def retrieved_examples_xml(exemplars, budget=None) -> Column:
    """Exemplars in retrieval order, grouped by their ``for_type``; groups without a fitting exemplar are left out."""
    coded = F.transform(_c(exemplars), lambda x: F.struct(x.alias("x"), X.drop_comment_lines(x["code_text"]).alias("code")))
    if budget is not None:
        coded = fit_budget(coded, lambda e: F.length(e["code"]) + F.length(X.xml_escape(e["x"]["description"])), budget)
    groups = F.array_distinct(F.transform(coded, lambda e: e["x"]["for_type"]))
    return X.xml_list("retrieved_examples", F.transform(groups, lambda g: F.concat(
        F.lit('  <for_type name="'), X.xml_escape(g), F.lit('">\n'),
        F.array_join(F.transform(F.filter(coded, lambda e: e["x"]["for_type"] == g), lambda e: _example("    ", e["x"], e["code"])), "\n"),
        F.lit("\n  </for_type>"))))


def trophies_xml(trophies) -> Column:
    """Ranked successful cases: distinct labels in order, the diff line by line."""
    def one(t: Column) -> Column:
        names = F.array_join(F.array_distinct(F.filter(t["ground_truth"], lambda x: x != "")), ", ")
        body = F.transform(X.lines(X.strip(t["diff_snippet"])), lambda ln: F.concat(F.lit("      "), X.text_escape(ln)))
        return F.concat(F.lit('  <example sim="'), t["sim"].cast("string"), F.lit('" types="'), X.text_escape(names),
                        F.lit('">\n    <diff>\n'), F.array_join(body, "\n"), F.lit("\n    </diff>\n  </example>"))

    body = F.array_join(F.transform(_c(trophies), one), "\n")
    return F.when(F.coalesce(F.size(_c(trophies)), F.lit(0)) <= 0, F.lit("")).otherwise(
        F.concat(F.lit("<successful_examples>\n"), body, F.lit("\n</successful_examples>")))


def confusion_hints_xml(detected, texts: dict[str, str]) -> Column:
    """Hint lines for detected labels, and for compounds that should be ruled out."""
    found = _c(detected)
    book = F.create_map(*[F.lit(v) for pair in texts.items() for v in pair]) if texts else F.create_map().cast("map<string,string>")
    line = lambda t, mark: F.concat(F.lit('  <hint type="'), X.xml_escape(t), F.lit(f'"{mark}>'),
                                    X.xml_escape(F.try_element_at(book, t)), F.lit("</hint>"))
    known = lambda c: F.filter(c, lambda t: F.try_element_at(book, t).isNotNull())
    own = F.transform(known(found), lambda t: line(t, ""))
    triggered = F.arrays_overlap(found, F.array(*[F.lit(t) for t in L.COMPOUND_TRIGGERS]))
    rest = F.when(triggered, F.array_except(F.array(*[F.lit(c) for c in L.COMPOUNDS]), found)).otherwise(F.array().cast("array<string>"))
    return X.xml_list("confusion_hints", F.concat(own, F.transform(known(rest), lambda t: line(t, ' status="check_compound"'))))


def confusion_hints_text(detected, texts: dict[str, str]) -> Column:
    """The same hints as plain lines, with the labels that are often missed."""
    found = _c(detected)
    book = F.create_map(*[F.lit(v) for pair in texts.items() for v in pair]) if texts else F.create_map().cast("map<string,string>")
    none = F.array().cast("array<string>")

    def listed(names: Column, note: str) -> Column:
        known = F.filter(names, lambda t: F.try_element_at(book, t).isNotNull())
        return F.transform(known, lambda t: F.concat(F.lit("* **"), t, F.lit(f"**{note}: "), F.try_element_at(book, t)))

    triggered = F.arrays_overlap(found, F.array(*[F.lit(t) for t in L.COMPOUND_TRIGGERS]))
    rest = F.when(triggered, F.array_except(F.array(*[F.lit(c) for c in L.COMPOUNDS]), found)).otherwise(none)
    missed = F.array_except(F.array(*[F.lit(t) for t in L.OFTEN_MISSED]), found)
    lines = F.concat(listed(found, ""), listed(rest, " (not detected, rule it out)"), listed(missed, " (not detected, check)"))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit("No specific confusion hints for these types."))


def level_glossary(definitions: DataFrame, terms: DataFrame, compounds: DataFrame) -> DataFrame:
    """``(level, reference_xml)`` from the definition, term and compound-note tables.

    Labels are matched to definitions by exact name; terms are the words of the
    label names and the runs of words in them, so they meet in an equality join.
    """
    spark = definitions.sparkSession
    types = spark.createDataFrame(
        [(lv, i, n) for lv, names in L.LEVELS.items() for i, n in enumerate(names)], "level string, ord int, type string")
    defs = types.join(definitions.select("type", "definition"), "type").where("definition <> ''").groupBy("level").agg(
        F.array_sort(F.collect_list(F.struct("ord", F.concat(
            F.lit('    <definition type="'), "type", F.lit('">'), "definition", F.lit("</definition>")).alias("x")))).alias("v"))
    word = F.split(F.replace("type", F.lit(" And "), F.lit(" ")), " ")
    runs = F.flatten(F.transform(word, lambda _, i: F.transform(
        F.sequence(F.lit(1), F.size(word) - i), lambda n: F.array_join(F.slice(word, i + 1, n), " "))))
    used = types.select("level", F.explode(F.array_distinct(runs)).alias("term")).join(terms, "term").select(
        "level", "role", "term", "text").distinct()
    glossary = used.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("role", "term", F.concat(
        F.lit('    <term name="'), "term", F.lit('" role="'), "role", F.lit('">'), "text", F.lit("</term>")).alias("x")))).alias("v"))
    notes = types.join(compounds.select("type", "note"), "type").groupBy("level").agg(
        F.array_sort(F.collect_list(F.struct("ord", F.concat(
            F.lit('    <compound type="'), "type", F.lit('">'), "note", F.lit("</compound>")).alias("x")))).alias("v"))
    out = types.select("level").distinct()
    blocks = []
    for name, part in (("type_definitions", defs), ("term_glossary", glossary), ("compound_types", notes)):
        out = out.join(part.select("level", F.transform("v", lambda r: r["x"]).alias(name)), "level", "left")
        blocks.append(F.when(F.size(name) > 0, F.concat(
            F.lit(f"  <{name}>\n"), F.array_join(name, "\n"), F.lit(f"\n  </{name}>"))))
    return out.select("level", F.concat_ws("\n", F.lit("<reference>"), *blocks, F.lit("</reference>")).alias("reference_xml"))


# Messages

def message_pair(system, user, no_think: bool = False) -> Column:
    """System and user message; the directive that switches reasoning off is added once."""
    s = _c(system)
    if no_think:
        s = F.when(F.contains(s, F.lit("/no_think")), s).otherwise(
            F.concat(F.regexp_replace(s, r"\s+$", ""), F.lit("\n\n/no_think")))
    return F.array(F.struct(F.lit("system").alias("role"), s.alias("content")),
                   F.struct(F.lit("user").alias("role"), _c(user).alias("content")))


def format_messages(messages) -> Column:
    """Messages as one text, in order."""
    return F.array_join(F.transform(_c(messages), lambda m: F.concat(
        F.lit("--- "), m["role"], F.lit(" ---\n"), m["content"])), "\n")


def transcript(turns: DataFrame, key: str, turn: str, role: str, text: str, page_turns: int | None = None) -> DataFrame:
    """Conversations as one text each: ``(key, page, n_turns, transcript)``, page 0 only.

    With ``page_turns`` a conversation is cut into pages of that many turns, so an
    endless one spreads over many groups; its text is its pages in order.
    """
    block = F.concat(F.lit("--- "), role, F.lit(" ---\n"), text)
    page = (F.lit(0) if page_turns is None else F.floor(F.col(turn) / page_turns)).cast("bigint")
    paged = turns.select(key, page.alias("page"), F.col(turn).alias("_t"), block.alias("_b"))
    return paged.groupBy(key, "page").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_b"))), lambda x: x["_b"]), "\n").alias("transcript"))
