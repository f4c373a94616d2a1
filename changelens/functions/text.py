"""String expressions over code, diffs and labels.

All of them are built-in JVM expressions. Regular expressions use possessive
quantifiers where a group repeats, which keeps matching linear on long texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens import labels

# Characters at which a text is cut into lines (besides a plain newline).
_LINE_ENDS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"
# A word next to an accented letter is not an identifier, hence the Unicode boundaries.
# The first look-ahead passes over all other characters cheaply.
IDENTIFIER = r"(?=[A-Za-z_])(?<![\p{L}\p{N}_])[A-Za-z_][A-Za-z0-9_]*+(?![\p{L}\p{N}_])"
IDENTIFIER_3 = r"(?=[A-Za-z_])(?<![\p{L}\p{N}_])[A-Za-z_][A-Za-z0-9_]{2,}+(?![\p{L}\p{N}_])"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank(col) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(~_c(col).rlike(r"\S"), F.lit(True))


def strip(col) -> Column:
    return F.regexp_replace(_c(col), r"^\s++|\s++$", "")


def unify_newlines(col) -> Column:
    return F.regexp_replace(_c(col), _LINE_ENDS, "\n")


def rstrip_lines(col) -> Column:
    return F.regexp_replace(_c(col), r"(?m)[^\S\n]++$", "")


def lines(col) -> Column:
    """Lines without their ends; a final line end opens no extra line."""
    return F.split(F.regexp_replace(unify_newlines(col), r"\n\z", ""), "\n")


def replace_first(col, needle: str, new: str) -> Column:
    c = _c(col)
    at = F.locate(needle, c)
    return F.when(
        at > 0,
        F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(needle), F.length(c))),
    ).otherwise(c)


def identifiers(col, pattern: str = IDENTIFIER) -> Column:
    """Identifier tokens in order, duplicates kept."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(pattern), F.lit(0))


def words_3(col) -> Column:
    """Distinct Unicode words of at least three characters."""
    return F.array_distinct(
        F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(r"[\p{L}\p{N}_]{3,}+"), F.lit(0))
    )


# Labels

def normalize_type(col) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(strip(col), r"\s+", " ")), F.lit(""))


def squeeze_type(col) -> Column:
    """Key that ignores case, blanks and underscores."""
    return F.regexp_replace(F.lower(_c(col)), "[ _]", "")


def is_known_type(col) -> Column:
    return normalize_type(col).isin([n.lower() for n in labels.KNOWN_TYPES])


def parse_type_list(col) -> Column:
    parts = F.transform(F.split(F.coalesce(_c(col), F.lit("")), ","), strip)
    return F.filter(parts, lambda t: ~F.lower(t).isin("", "none", "n/a"))


def parse_level_list(col) -> Column:
    parts = F.transform(
        F.split(F.coalesce(_c(col), F.lit("")), ","),
        lambda p: F.regexp_replace(F.lower(strip(p)), " ", "_"),
    )
    return F.filter(parts, lambda p: p.isin(list(labels.LEVELS)))


def level_map() -> Column:
    pairs = [(n, lv) for lv, names in labels.LEVELS.items() for n in names]
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])


def level_of(col) -> Column:
    return F.element_at(level_map(), _c(col))


def has_level(types, level: str) -> Column:
    return F.arrays_overlap(_c(types), F.array(*[F.lit(t) for t in labels.LEVELS[level]]))


# Code cleaning

def _collapse(col) -> Column:
    return F.regexp_replace(col, r"\n{3,}", "\n\n")


def clean_python(col) -> Column:
    """Drop triple-quoted strings and comments; quotes protect ``#``; quote state is per line."""
    c = _c(col)
    out = F.regexp_replace(c, r'"""[\s\S]*?"""', "")
    out = F.regexp_replace(out, r"'''[\s\S]*?'''", "")
    out = F.regexp_replace(
        out,
        r"(?md)^((?:[^\"'#\n]++"
        r"|\"(?:\\[^\n]|[^\"\\\n])*+(?:\"|\\?$)"
        r"|'(?:\\[^\n]|[^'\\\n])*+(?:'|\\?$))*+)#[^\n]*+$",
        "$1",
    )
    return F.when(blank(c), c).otherwise(strip(_collapse(rstrip_lines(out))))


def clean_java(col) -> Column:
    """Drop block and line comments anywhere, then tidy blank runs."""
    c = _c(col)
    out = F.regexp_replace(c, r"/\*[\s\S]*?\*/", "")
    out = _collapse(F.regexp_replace(out, r"//[^\n]*+", ""))
    return F.when(blank(c), c).otherwise(strip(rstrip_lines(out)))


def drop_comment_lines(col) -> Column:
    """Drop lines that hold nothing but a ``//`` comment."""
    out = F.regexp_replace(unify_newlines(col), r"(?md)^[^\S\n]*+//[^\n]*+(?:\n|\z)", "")
    return F.coalesce(strip(_collapse(rstrip_lines(out))), F.lit(""))


def clean_diff(col) -> Column:
    out = rstrip_lines(F.regexp_replace(unify_newlines(col), r"\n\z", ""))
    return F.regexp_replace(out, r"(?md)^\n{3,}", "\n\n")


def clean_exemplar_before(col) -> Column:
    """Keep the header in front of the code marker and clean only the code."""
    c = _c(col)

    def keep_header(marker: str, header_len: int) -> Column:
        at = F.locate(marker, c)
        cut = at + header_len
        return F.concat(
            F.substring(c, F.lit(1), cut - 1), clean_java(F.substring(c, cut, F.length(c)))
        )

    return (
        F.when(blank(c), c)
        .when(F.contains(c, F.lit("BEFORE:\n")), keep_header("BEFORE:\n", 8))
        .when(F.contains(c, F.lit("// FILE:")), keep_header("// FILE:", 0))
        .otherwise(clean_python(c))
    )


# Records

KEY_CHARS = 180


def case_key(record_id, url, diff) -> Column:
    """Stable key: record id, else url, else digest of the diff; path signs become ``_``.

    A key over ``KEY_CHARS`` characters is its digest and its end, so different keys stay different.
    """
    raw = F.coalesce(
        F.nullif(_c(record_id), F.lit("")),
        F.nullif(_c(url), F.lit("")),
        F.md5(F.coalesce(_c(diff), F.lit(""))),
    )
    key = F.translate(raw, "/:", "__")
    return F.when(F.length(key) <= KEY_CHARS, key).otherwise(F.concat(F.md5(raw), F.lit("_"), F.right(key, F.lit(KEY_CHARS - 33))))


def split_code_text(col) -> Column:
    """Split a before/after blob into a struct of two texts."""
    c = F.coalesce(_c(col), F.lit(""))
    mark = "\n\nAFTER:\n"
    at = F.locate(mark, c)
    head = F.substring(c, F.lit(1), at - 1)
    before = (
        F.when(at > 0, F.when(head.startswith("BEFORE:\n"), F.substring(head, F.lit(9), F.length(head))).otherwise(head))
        .when(F.contains(c, F.lit("BEFORE:\n")), replace_first(c, "BEFORE:\n", ""))
        .when(F.contains(c, F.lit("AFTER:\n")), F.lit(""))
        .otherwise(c)
    )
    after = (
        F.when(at > 0, F.substring(c, at + len(mark), F.length(c)))
        .when(F.contains(c, F.lit("BEFORE:\n")), F.lit(""))
        .when(F.contains(c, F.lit("AFTER:\n")), replace_first(c, "AFTER:\n", ""))
        .otherwise(F.lit(""))
    )
    return F.struct(before.alias("code_before"), after.alias("code_after"))


def exemplar_text(code_text, before, after) -> Column:
    """Cleaned exemplar code: its own text, else the before and after parts."""
    cb, ca = (F.coalesce(_c(x), F.lit("")) for x in (before, after))
    joined = F.concat(
        F.when(cb != "", F.concat(F.lit("BEFORE:\n"), cb, F.lit("\n"))).otherwise(""),
        F.when(ca != "", F.concat(F.lit("AFTER:\n"), ca)).otherwise(""),
    )
    return drop_comment_lines(F.coalesce(F.nullif(_c(code_text), F.lit("")), joined))


def truncate(col, limit: int = 1500) -> Column:
    c = F.coalesce(_c(col), F.lit(""))
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("...[truncated]"))).otherwise(c)


def iso_millis(epoch_seconds) -> Column:
    return F.date_format(F.timestamp_millis((_c(epoch_seconds) * 1000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS")


# Markup

def xml_escape(col) -> Column:
    c = F.coalesce(_c(col), F.lit(""))
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def text_escape(col) -> Column:
    """Escape without the quote sign, as used inside fact blocks."""
    c = F.coalesce(_c(col), F.lit(""))
    for raw, esc in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def xml_unescape(col) -> Column:
    c = _c(col)
    for esc, raw in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(esc), F.lit(raw))
    return c


def xml_list(tag: str, items: Column) -> Column:
    """Wrap rendered lines in ``tag``; an empty list gives a self-closing tag."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(f"<{tag}/>")).otherwise(
        F.concat(F.lit(f"<{tag}>\n"), F.array_join(items, "\n"), F.lit(f"\n</{tag}>"))
    )


def diff_xml(col) -> Column:
    return F.when(blank(col), F.lit("<python_diff/>")).otherwise(
        F.concat(F.lit("<python_diff>\n"), clean_diff(col), F.lit("\n</python_diff>"))
    )


def detections_xml(tag: str, detections) -> Column:
    """Render an array of ``(type, evidence)`` structs."""
    return xml_list(tag, F.transform(_c(detections), lambda d: F.concat(
        F.lit('  <type evidence="'), xml_escape(d["evidence"]), F.lit('">'),
        xml_escape(d["type"]), F.lit("</type>"))))


def candidates_xml(types) -> Column:
    return xml_list("candidate_missing_types", F.transform(_c(types), lambda t: F.concat(
        F.lit("  <type>"), xml_escape(t), F.lit("</type>"))))
