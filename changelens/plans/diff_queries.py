"""Diff, reply and fact queries over the derived change records."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens import labels as L
from changelens.functions import diffs, replies as P, text as X
from changelens.functions.rows import inline_rows, pos_rows
from changelens.operators import filters, signals, structure
from changelens.operators.context import format_case
from changelens.plans import derived as D
from changelens.plans.derived import cases, table


def _paired(spark, d):
    return signals.with_pairs(cases(spark, d).select("case_id", "commit_diff"))


def diff_hunks(spark, d):
    hunks = pos_rows(cases(spark, d), diffs.hunks("commit_diff"), "case_id", names=("hunk", "h"))
    return hunks.select("case_id", F.col("hunk").cast("bigint").alias("hunk"), "h.file",
                        F.size(diffs.body_lines(F.col("h.body"))).cast("bigint").alias("n_lines"),
                        F.md5("h.body").alias("body_md5"))


def run_pairing(spark, d):
    return inline_rows(_paired(spark, d), "pairs", "case_id")


def token_rename_votes(spark, d):
    return signals.rename_votes(signals.vote_counts(_paired(spark, d), swaps=False)).select("case_id", "old", "new", "hits")


def self_prefix_swaps(spark, d):
    return signals.self_swaps(signals.vote_counts(_paired(spark, d), renames=False)).select("case_id", "kind", "old", "new", "hits")


def _moves(spark, d, sign):
    base = cases(spark, d).withColumn("bodies", diffs.bodies("commit_diff"))
    return inline_rows(base, diffs.body_moves("bodies", sign), "case_id").select(
        "case_id", "var", "expr", F.col("hits").cast("bigint").alias("hits"))


def extraction_hits(spark, d):
    return _moves(spark, d, "+")


def inlining_hits(spark, d):
    return _moves(spark, d, "-")


def condition_inversions(spark, d):
    return inline_rows(_paired(spark, d), diffs.inversions("pairs"), "case_id")


def condition_splits(spark, d):
    return inline_rows(_paired(spark, d), diffs.splits("runs"), "case_id")


def annotation_changes(spark, d):
    return inline_rows(_paired(spark, d), diffs.type_changes("pairs"), "case_id")


def signal_blocks(spark, d):
    out = signals.compute_signals(cases(spark, d))
    return out.select("case_id", F.array_join(signals.signal_tags("signals"), ",").alias("tags"),
                      F.md5(signals.signals_xml("signals")).alias("xml_md5"))


def structural_delta(spark, d):
    return structure.compute_facts(cases(spark, d)).select(
        "case_id", "category", "kind", "name", "cls", "file", "from_file", "from_class",
        F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


def fact_blocks(spark, d):
    return structure.fact_texts(cases(spark, d)).select(
        "case_id", F.md5("facts_xml").alias("xml_md5"), F.length("facts_xml").cast("bigint").alias("n_chars"))


def evidence_gates(spark, d):
    """Each claimed label against the facts and signals of its own case."""
    joined = filters.with_evidence(cases(spark, d))

    def claim(label: str, evidence: str):
        # a claim's label is a constant, so only its own gate is left of the expression
        keep = filters.structural_gate(F.lit(label), F.lit(evidence), "commit_diff", "facts", "tags")
        reason = filters.addition_reason(
            F.lit(label), F.array(F.lit("Rename Variable")), F.lit(0.5), F.col("facts.kinds"), F.col("tags"))
        return F.struct(F.lit(label).alias("type"), keep.alias("keep"), reason.alias("reason"))

    claims = joined.select("case_id", F.array(*[claim(t, e) for t, e in CLAIMS]).alias("claims"))
    return claims.select("case_id", F.inline("claims"))


CLAIMS = [("Invert Condition", ""), ("Split Conditional", ""), ("Add Parameter", "+    def total(self, x, taxed):"),
          ("Remove Parameter", "total"), ("Move Method", "+    def audit(self):"), ("Extract Superclass", "+class Other:"),
          ("Move Class", ""), ("Rename Attribute", ""), ("Move And Rename Method", ""), ("Rename Variable", ""), ("Move Code", "")]


def _numbered(items, kind):
    return F.transform(items, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.cast("bigint").alias("pos"), x["type"].alias("type"), x["evidence"].alias("evidence")))


def reply_two_step(spark, d):
    r = D.replies(spark, d).select("case_id", P.parse_two_step("reply").alias("p"))
    return inline_rows(r, F.concat(_numbered("p.defined", "defined"), _numbered("p.undefined", "undefined")), "case_id")


def reply_confidences(spark, d):
    r = inline_rows(D.replies(spark, d), F.map_entries(P.parse_confidences("verified")), "case_id")
    return r.select(F.col("case_id"), F.col("key").alias("type"), F.col("value").alias("confidence")).select("case_id", "type", F.col("confidence").cast("bigint").alias("confidence"))


def prompt_text(spark, d):
    """The change as prompt text, with markup escaped."""
    out = cases(spark, d).select("case_id", X.diff_xml(format_case("commit_diff", "code_before", "code_after")).alias("t"))
    return out.select("case_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(X.xml_escape("t")).alias("escaped_md5"),
                      (X.xml_unescape(X.xml_escape("t")) == F.col("t")).alias("round_trip"))


def page_titles(spark, d):
    """Title block of every page, markup unescaped."""
    t = F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return table(spark, d, "pages").select("page_id", X.xml_unescape(X.strip(t)).alias("title"))


def comment_strip(spark, d):
    """Comment lines and block comments out of every page source."""
    return table(spark, d, "pages").select(
        "page_id", F.md5(X.clean_java("html")).alias("java_md5"), F.md5(X.drop_comment_lines("html")).alias("lines_md5"))


def python_cleanup(spark, d):
    code = F.concat("text", F.lit("\nx = '#keep' # note\n\n\n\ny = \"a\\\"#b\" + '#' #end\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_python(code)).alias("clean_md5"))


QUERIES = {f.__name__: f for f in (
    diff_hunks, run_pairing, token_rename_votes, self_prefix_swaps, extraction_hits, inlining_hits, condition_inversions,
    condition_splits, annotation_changes, signal_blocks, structural_delta, fact_blocks, evidence_gates, reply_two_step,
    reply_confidences, prompt_text, page_titles, comment_strip, python_cleanup)}

_NOISE = ", ".join(f"'{n}'" for n in L.NOISE_NAMES)
_IDS = r"list_filter(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_]*'))"
_RENAMES = D.DUCK_PAIRS + f""",
toks AS (SELECT case_id, {_IDS.format(c='before')} AS b, {_IDS.format(c='after')} AS a FROM pairs),
subs AS (SELECT case_id, unnest(b) AS old, unnest(a) AS new FROM toks WHERE len(a) = len(b)),
counts AS (SELECT case_id, old, new, count(*) AS hits FROM subs
           WHERE old <> new AND old NOT IN ({_NOISE}) AND new NOT IN ({_NOISE}) GROUP BY ALL),
rated AS (SELECT *, nth_value(hits, 2) OVER (PARTITION BY case_id, old ORDER BY hits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2,
                    nth_value(hits, 2) OVER (PARTITION BY case_id, new ORDER BY hits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS o2 FROM counts),
renames AS (SELECT case_id, old, new, hits FROM rated WHERE hits >= 2
            AND coalesce(n2, 0) < greatest(2, hits // 2) AND coalesce(o2, 0) < greatest(2, hits // 2))"""
_SELF = r"'\bself\.([A-Za-z_][A-Za-z0-9_]*)'"
_SWAPS = D.DUCK_PAIRS + f""",
votes AS (SELECT case_id, 'var_to_attr' AS kind, unnest(regexp_extract_all(after, {_SELF}, 1)) AS name, before AS other FROM pairs
          UNION ALL SELECT case_id, 'attr_to_var', unnest(regexp_extract_all(before, {_SELF}, 1)), after FROM pairs),
swaps AS (SELECT case_id, kind, CASE WHEN kind = 'var_to_attr' THEN name ELSE 'self.' || name END AS old,
                 CASE WHEN kind = 'var_to_attr' THEN 'self.' || name ELSE name END AS new, count(*) AS hits
          FROM votes WHERE contains(other, name) AND NOT contains(other, 'self.' || name) GROUP BY ALL HAVING count(*) >= 2)"""


def _moves_sql(sign: str, name: str) -> str:
    other = "-" if sign == "+" else "+"
    extra = "AND (contains(expr, '(') OR contains(expr, '.'))" if sign == "+" else ""
    return f""",
asg_{name} AS (SELECT case_id, hunk, pos, regexp_extract(line, '^\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(.+?)\\s*$', 1) AS var,
              regexp_extract(line, '^\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*(.+?)\\s*$', 2) AS expr FROM body WHERE sign = '{sign}'),
ok_{name} AS (SELECT * FROM asg_{name} WHERE var <> '' AND var NOT IN ({_NOISE}) AND length(expr) >= 8 {extra}),
{name} AS (SELECT a.case_id, a.pos, a.var, a.expr,
        count(*) FILTER (b.sign = '{sign}' AND contains(b.line, a.var) AND NOT contains(b.line, a.expr)) AS hits,
        count(*) FILTER (b.sign = '{other}' AND contains(b.line, a.expr)) AS src
      FROM ok_{name} a JOIN body b ON a.case_id = b.case_id AND a.hunk = b.hunk AND b.pos > a.pos
      GROUP BY ALL HAVING hits >= 2 AND src >= 1)"""


_FLIP = " OR ".join(
    f"(strpos(b, '{o}') > 0 AND left(b, strpos(b, '{o}') - 1) || '{n}' || substr(b, strpos(b, '{o}') + {len(o)}) = a)"
    for o, n in L.COMPARATOR_FLIPS)
_INV = D.DUCK_PAIRS + rf""",
conds AS (SELECT case_id, hunk, pos, regexp_replace(before, '^\s+|\s+$', '', 'g') AS b, regexp_replace(after, '^\s+|\s+$', '', 'g') AS a FROM pairs
  WHERE regexp_matches(before, '^\s*(if|elif|while|assert)\s+') AND regexp_matches(after, '^\s*(if|elif|while|assert)\s+')),
inv AS (SELECT case_id, hunk, pos, b AS before, a AS after FROM conds
  WHERE contains(b, ' not ') <> contains(a, ' not ') OR {_FLIP})"""
_SPLIT = r""",
nxt AS (SELECT m.case_id, m.hunk, m.pos, m.line, p1.line AS outer_l, p2.line AS inner_l
        FROM numbered m JOIN numbered p1 ON m.case_id = p1.case_id AND m.hunk = p1.hunk AND p1.run = m.run + 1 AND p1.i = 1 AND p1.sign = '+'
        JOIN numbered p2 ON m.case_id = p2.case_id AND m.hunk = p2.hunk AND p2.run = m.run + 1 AND p2.i = 2
        WHERE m.sign = '-' AND regexp_matches(m.line, '^\s*if\s+(.+?)\s+(?:and|or)\s+(.+?):\s*$')),
spl AS (SELECT case_id, trim(line) AS before, trim(outer_l) AS after_outer, trim(inner_l) AS after_inner
        FROM nxt WHERE regexp_matches(outer_l, '^\s*if\s+') AND regexp_matches(inner_l, '^\s*if\s+')
        AND length(inner_l) - length(ltrim(inner_l)) > length(outer_l) - length(ltrim(outer_l)))"""
_ANN = r"'^\s*([A-Za-z_][A-Za-z0-9_]*)\s*:\s*([^=]+?)(?:=|$)'"
_TYPES = f""",
ann AS (SELECT DISTINCT case_id, regexp_extract(before, {_ANN}, 1) AS name, regexp_extract(after, {_ANN}, 1) AS other,
        trim(regexp_extract(before, {_ANN}, 2)) AS before, trim(regexp_extract(after, {_ANN}, 2)) AS after FROM pairs),
types AS (SELECT case_id, name, before, after FROM ann
          WHERE name <> '' AND name = other AND before <> '' AND after <> '' AND before <> after)"""


def _xml_sql() -> str:
    """Tags and rendered blocks of all seven signal lists."""
    esc = lambda c: f"replace(replace(replace(CAST({c} AS VARCHAR), '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"
    blocks = [("renames", "rename", "renames", ["old", "new", "hits"], "hits DESC"),
              ("self_swaps", "swap", "swaps", ["kind", "old", "new", "hits"], "hits DESC"),
              ("extractions", "extract", "ext", ["var", "expr", "hits"], "hits DESC, pos"),
              ("inlinings", "inline", "inl", ["var", "expr", "hits"], "hits DESC, pos"),
              ("inversions", "invert", "inv", ["before", "after"], "pos"),
              ("splits", "split", "spl", ["before", "after_outer", "after_inner"], "before"),
              ("type_changes", "type_change", "types", ["name", "before", "after"], "name")]
    parts = []
    for i, (block, tag, src, fields, order) in enumerate(blocks):
        attrs = " || ".join(f"' {f}=\"' || {esc(f)} || '\"'" for f in fields)
        parts.append(
            f"SELECT case_id, {i} AS o, '{tag}' AS tag, '  <{block}>' || chr(10) || string_agg('    <{tag}' || {attrs} || ' />', chr(10) ORDER BY {order}) "
            f"|| chr(10) || '  </{block}>' AS x FROM {src} GROUP BY case_id")
    renames = _RENAMES.removeprefix(D.DUCK_PAIRS)
    swaps = _SWAPS.removeprefix(D.DUCK_PAIRS)
    inv = _INV.removeprefix(D.DUCK_PAIRS)
    return (f"WITH {D.DUCK_PAIRS}{renames}{swaps}{_moves_sql('+', 'ext')}{_moves_sql('-', 'inl')}{inv}{_SPLIT}{_TYPES}, blocks AS ("
            + " UNION ALL ".join(parts) + """)
SELECT c.case_id, coalesce(string_agg(tag, ',' ORDER BY o), '') AS tags,
md5(coalesce('<intra_method_signals>' || chr(10) || string_agg(x, chr(10) ORDER BY o) || chr(10) || '</intra_method_signals>', '')) AS xml_md5
FROM cases c LEFT JOIN blocks b ON c.case_id = b.case_id GROUP BY c.case_id""")


# expected facts follow from how the texts are written, not from parsing them
_FACTS = f"""facts AS (
SELECT case_id, 'inheritance' AS category, 'changed' AS kind, 'Order' || {D.PRIO} AS name, 'Order' || {D.PRIO} AS cls, 'pkg/main.py' AS file,
  NULL AS from_file, NULL AS from_class, 'Base' AS before, 'Base,Mixin' AS after FROM cases WHERE {D.OPEN}
UNION ALL SELECT case_id, 'signatures', 'changed', 'Order' || {D.PRIO} || '.total', 'Order' || {D.PRIO}, 'pkg/main.py', NULL, NULL, 'self,x', 'self,x,taxed' FROM cases WHERE {D.URGENT}
UNION ALL SELECT case_id, 'attributes', 'added', {D.NEW}, 'Order' || {D.PRIO}, 'pkg/main.py', NULL, NULL, NULL, NULL FROM cases
UNION ALL SELECT case_id, 'attributes', 'removed', {D.OLD}, 'Order' || {D.PRIO}, 'pkg/main.py', NULL, NULL, NULL, NULL FROM cases
UNION ALL SELECT case_id, 'files', 'renamed', 'pkg/helpers.py', NULL, 'pkg/helpers.py', 'pkg/util.py', NULL, NULL, NULL FROM cases WHERE {D.FILLED}
UNION ALL SELECT case_id, 'methods', 'moved', 'helper', NULL, 'pkg/helpers.py', 'pkg/util.py', NULL, NULL, NULL FROM cases WHERE {D.FILLED}
UNION ALL SELECT case_id, 'classes', 'added', 'Auditor', NULL, 'pkg/main.py', NULL, NULL, NULL, NULL FROM cases WHERE {D.DEAR}
UNION ALL SELECT case_id, 'methods', 'moved', 'audit', 'Auditor', 'pkg/main.py', 'pkg/main.py', 'Order' || {D.PRIO}, NULL, NULL FROM cases WHERE {D.DEAR})"""


def _fact_xml_sql() -> str:
    o, q = f"'Order' || {D.PRIO}", '"'
    line = lambda cond, text: f"CASE WHEN {cond} THEN {D.tpl(text)} || chr(10) ELSE '' END"
    x = " || ".join([
        "'<structural_facts>' || chr(10)",
        line(D.FILLED, '  <files renamed=[{{from="pkg/util.py" to="pkg/helpers.py" similarity="1.0"}}] />'),
        line(D.DEAR, '  <classes added=[{{name="Auditor" file="pkg/main.py"}}] />'),
        f"CASE WHEN {D.FILLED} OR {D.DEAR} THEN '  <methods moved=[' || concat_ws(', ', "
        f"CASE WHEN {D.FILLED} THEN '{{name=\"helper\" from_class=\"None\" to_class=\"None\" from_file=\"pkg/util.py\" to_file=\"pkg/helpers.py\" similarity=\"1.0\"}}' END, "
        f"CASE WHEN {D.DEAR} THEN '{{name=\"audit\" from_class=\"' || {o} || '\" to_class=\"Auditor\" from_file=\"pkg/main.py\" to_file=\"pkg/main.py\" similarity=\"1.0\"}}' END) || '] />' || chr(10) ELSE '' END",
        f"CASE WHEN {D.URGENT} THEN '  <signatures changed=[{{method={q}' || {o} || '.total{q} file={q}pkg/main.py{q} before_params={q}[' || chr(39) || 'self' || chr(39) || ', ' || chr(39) || 'x' || chr(39) || ']{q} after_params={q}[' || chr(39) || 'self' || chr(39) || ', ' || chr(39) || 'x' || chr(39) || ', ' || chr(39) || 'taxed' || chr(39) || ']{q}}}] />' || chr(10) ELSE '' END",
        f"CASE WHEN {D.OPEN} THEN '  <inheritance changed=[{{class={q}' || {o} || '{q} file={q}pkg/main.py{q} before_bases={q}[' || chr(39) || 'Base' || chr(39) || ']{q} after_bases={q}[' || chr(39) || 'Base' || chr(39) || ', ' || chr(39) || 'Mixin' || chr(39) || ']{q}}}] />' || chr(10) ELSE '' END",
        f"'  <attributes added=[{{class={q}' || {o} || '{q} file={q}pkg/main.py{q} name={q}' || {D.NEW} || '{q}}}] removed=[{{class={q}' || {o} || '{q} file={q}pkg/main.py{q} name={q}' || {D.OLD} || '{q}}}] />' || chr(10)",
        "'</structural_facts>'"])
    return f"WITH {D.DUCK_CASES}, x AS (SELECT case_id, {x} AS x FROM cases) SELECT case_id, md5(x) AS xml_md5, length(x) AS n_chars FROM x"


_GATE = {
    "Invert Condition": (f"{D.FILLED} OR {D.OPEN}", None), "Split Conditional": (D.URGENT, None), "Add Parameter": ("true", None),
    "Remove Parameter": (D.URGENT, None), "Move Method": (D.DEAR, None), "Extract Superclass": ("false", "class"),
    "Move Class": ("false", "class"), "Rename Attribute": ("true", None), "Move And Rename Method": ("true", "two"),
    "Rename Variable": ("true", None), "Move Code": ("true", None),
}


def _gates_sql() -> str:
    rows = []
    renamed = f"NOT ({D.DEAR})"
    for t, (keep, _) in _GATE.items():
        if t == "Invert Condition":
            reason = f"CASE WHEN NOT ({keep}) THEN 'intra_gate_missing' END"
        elif t == "Split Conditional":
            reason = f"CASE WHEN NOT ({keep}) THEN 'intra_gate_missing' END"
        elif t == "Rename Attribute":
            reason = f"CASE WHEN NOT ({renamed}) THEN 'intra_gate_missing' END"
        elif t == "Move And Rename Method":
            reason = f"CASE WHEN NOT ({D.FILLED}) THEN 'two_step_missing_primitives' END"
        else:
            reason = "CAST(NULL AS VARCHAR)"
        rows.append(f"SELECT case_id, '{t}' AS type, ({keep}) AS keep, {reason} AS reason FROM cases")
    return f"WITH {D.DUCK_CASES} " + " UNION ALL ".join(rows)


_EV = r"""(?is)<type\s+(?:confidence="(\d+)"\s+)?evidence="(.*?)"\s*/?>\s*([^<>]*?)\s*</type>"""
_FIXED = r"""regexp_replace(regexp_replace(reply, '(?is)<think\b[^>]*>.*?</think\s*>', '', 'g'), '(?i)(<type\s+evidence="[^"]*")([A-Za-z])', '\1>\2', 'g')"""
_UNESC = "replace(replace(replace(replace({c}, '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"


def _two_step_sql() -> str:
    one = lambda k: f"""SELECT case_id, '{k}' AS kind, unnest(regexp_extract_all(b, '{_EV}', 3)) AS t, unnest(regexp_extract_all(b, '{_EV}', 2)) AS e,
      generate_subscripts(regexp_extract_all(b, '{_EV}', 2), 1) AS i
      FROM (SELECT case_id, regexp_extract(fixed, '(?is)<{k}\\b[^>]*>(.*?)</{k}\\s*>', 1) AS b FROM f WHERE NOT regexp_matches(fixed, '(?i)<{k}\\s*/>'))"""  # noqa: E731
    return f"""WITH {D.DUCK_REPLIES}, f AS (SELECT case_id, {_FIXED} AS fixed FROM replies), items AS ({one('defined')} UNION ALL {one('undefined')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id, kind, lower(trim(t)) ORDER BY i) AS again FROM items WHERE trim(t) <> '' AND trim(e) <> '')
SELECT case_id, kind, row_number() OVER (PARTITION BY case_id, kind ORDER BY i) - 1 AS pos, {_UNESC.format(c='trim(t)')} AS type, {_UNESC.format(c='trim(e)')} AS evidence
FROM ranked WHERE again = 1"""


_CODE = r"""text || chr(10) || 'x = ''#keep'' # note' || chr(10) || chr(10) || chr(10) || chr(10) || 'y = "a\"#b" + ''#'' #end' || chr(10)"""
_CLEAN_PY = r"""regexp_replace(regexp_replace({c}, '"{{3}}[\s\S]*?"{{3}}', '', 'g'), '''{{3}}[\s\S]*?''{{3}}', '', 'g')"""
_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_RSTRIP = r"regexp_replace({c}, '(?m)[^\S\n]+$', '', 'g')"
_COLLAPSE = r"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')"
_QUOTED = r"""'(?m)^((?:[^"''#\n]|"(?:\\[^\n]|[^"\\\n])*(?:"|\\?$)|''(?:\\[^\n]|[^''\\\n])*(?:''|\\?$))*)#[^\n]*$'"""


def _python_sql() -> str:
    code = _CLEAN_PY.format(c="(" + _CODE + ")")
    body = f"regexp_replace({code}, {_QUOTED}, '\\1', 'g')"
    out = _STRIP.format(c=_COLLAPSE.format(c=_RSTRIP.format(c=body)))
    return f"SELECT doc_id, md5({out}) AS clean_md5 FROM documents"


def _comments_sql() -> str:
    java = r"regexp_replace(regexp_replace(html, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g')"
    java = _STRIP.format(c=_RSTRIP.format(c=_COLLAPSE.format(c=java)))
    kept = "array_to_string(list_filter(string_split(html, chr(10)), lambda l: NOT regexp_matches(l, '^\\s*//')), chr(10))"
    rest = _STRIP.format(c=_COLLAPSE.format(c=_RSTRIP.format(c=kept)))
    return f"SELECT page_id, md5({java}) AS java_md5, md5({rest}) AS lines_md5 FROM pages"


_PROMPT = "'<python_diff>' || chr(10) || '## Python Commit Diff' || chr(10) || chr(10) || '```diff' || chr(10) || regexp_replace(commit_diff, '(?m)[ \\t]+$', '', 'g') || chr(10) || '```' || chr(10) || '</python_diff>'"

ORACLE = {
    "diff_hunks": f"WITH {D.DUCK_LINES}, h AS (SELECT case_id, hunk, min(file) AS file, count(*) AS n_lines, "
                  "md5(string_agg(sign || line || chr(10), '' ORDER BY pos)) AS body_md5 FROM body GROUP BY case_id, hunk) "
                  "SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY hunk) - 1 AS hunk, file, n_lines, body_md5 FROM h",
    "run_pairing": f"WITH {D.DUCK_PAIRS} SELECT case_id, before, after FROM pairs",
    "token_rename_votes": f"WITH {_RENAMES} SELECT * FROM renames",
    "self_prefix_swaps": f"WITH {_SWAPS} SELECT * FROM swaps",
    "extraction_hits": f"WITH {D.DUCK_LINES}{_moves_sql('+', 'ext')} SELECT case_id, var, expr, hits FROM ext",
    "inlining_hits": f"WITH {D.DUCK_LINES}{_moves_sql('-', 'inl')} SELECT case_id, var, expr, hits FROM inl",
    "condition_inversions": f"WITH {_INV} SELECT case_id, before, after FROM inv",
    "condition_splits": f"WITH {D.DUCK_PAIRS}{_SPLIT} SELECT * FROM spl",
    "annotation_changes": f"WITH {D.DUCK_PAIRS}{_TYPES} SELECT * FROM types",
    "signal_blocks": _xml_sql(),
    "structural_delta": f"WITH {D.DUCK_CASES}, {_FACTS} SELECT * FROM facts",
    "fact_blocks": _fact_xml_sql(),
    "evidence_gates": _gates_sql(),
    "reply_two_step": _two_step_sql(),
    "reply_confidences": f"""WITH {D.DUCK_REPLIES}, items AS (SELECT case_id, unnest(regexp_extract_all(verified, '{_EV}', 3)) AS type,
unnest(regexp_extract_all(verified, '{_EV}', 1)) AS c, generate_subscripts(regexp_extract_all(verified, '{_EV}', 1), 1) AS i FROM replies)
SELECT case_id, type, max_by(CAST(c AS BIGINT), i) AS confidence FROM items WHERE c <> '' GROUP BY case_id, type""",
    "prompt_text": f"""WITH {D.DUCK_CASES}, t AS (SELECT case_id, {_PROMPT} AS t FROM cases)
SELECT case_id, length(t) AS n_chars, md5(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5, true AS round_trip FROM t""",
    "page_titles": f"SELECT page_id, {_UNESC.format(c=_STRIP.format(c=chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<title' + chr(92) + 'b[^>]*>(.*?)</title' + chr(92) + 's*>' + chr(39) + ', 1)'))} AS title FROM pages",
    "comment_strip": _comments_sql(),
    "python_cleanup": _python_sql(),
}
