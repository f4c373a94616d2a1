"""SQL for the queries that SQL can express, from the same constants, each worked out in another way than the operator."""

from __future__ import annotations

from changelens.llm import op6_lines, op7_licenses, op8_mix, op11_lexical, op12_lloyd
from changelens.llm import op10_quality as q

_SPACE = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^\x{20}\x{09}-\x{0D}]+"


def lines_sql(run: int = op6_lines.RUN, long: int = op6_lines.LONG) -> str:
    """All stretches of lines are compared, without fingerprints."""
    leads = ", ".join(f"lead(line, {k}) OVER w AS l{k}, lead(words, {k}) OVER w AS w{k}" for k in range(1, run))
    later = []
    for size in range(1, run + 1):
        cols = ", ".join(["line", *(f"l{k}" for k in range(1, size))])
        held = f"l{run - 1} IS NOT NULL" if size == run else " + ".join(["words", *(f"w{k}" for k in range(1, size))]) + f" >= {long}"
        later.append(f"SELECT doc_id, seq, {size} AS size, row_number() OVER (PARTITION BY {cols} ORDER BY doc_id, seq) AS nth FROM r WHERE {held}")
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq, len(regexp_extract_all(line, '{_WORD}')) AS words FROM l WHERE trim(line, {_SPACE}) <> ''),
r AS (SELECT *, {leads} FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
later AS ({" UNION ALL ".join(later)}),
gone AS (SELECT DISTINCT s.doc_id, s.pos FROM later JOIN s ON s.doc_id = later.doc_id AND s.seq BETWEEN later.seq AND later.seq + later.size - 1 WHERE nth > 1),
clean AS (SELECT l.doc_id, count(gone.pos) AS n, string_agg(gone.pos::VARCHAR, ',' ORDER BY l.pos) AS removed, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS left_text
          FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::INTEGER AS n_lines, coalesce(n, 0)::INTEGER AS n_removed, coalesce(removed, '') AS removed,
       md5(CASE WHEN n > 0 THEN coalesce(left_text, '') ELSE text END) AS clean_md5, length(CASE WHEN n > 0 THEN coalesce(left_text, '') ELSE text END)::INTEGER AS clean_chars
FROM d LEFT JOIN clean USING (doc_id)"""


def licenses_sql(threshold: float = op7_licenses.THRESHOLD) -> str:
    """Every block against every template."""
    word = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
    rows = []
    for i, (kind, label, text) in enumerate(op7_licenses.TEMPLATES):
        own = sorted(set(op7_licenses.words(text)))
        rows.append(f"({i}, '{kind}', '{label}', {own}, {op7_licenses._need(len(own), threshold)})")
    cases = []
    for phrase, label in op7_licenses.PHRASES.items():
        parts = phrase.split(" ")
        fits = " AND ".join(f"ws[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        cases.append(f"SELECT doc_id, '{label}' AS label, i AS start FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w) WHERE {fits}")
    return f"""
WITH t(template, kind, label, own, need) AS (VALUES {", ".join(rows)}),
x AS (SELECT doc_id, lower(coalesce(text, '')) AS body FROM documents),
w AS (SELECT doc_id, regexp_extract_all(body, '{word}') AS ws FROM x),
p AS (SELECT doc_id, unnest(regexp_split_to_array(body, '\\n[ \\t\\r]*\\n')) AS par FROM x),
pl AS (SELECT doc_id, ls, unnest(range(greatest(len(ls) - {op7_licenses.LINES - 1}, 1))) AS i FROM (SELECT doc_id, string_split(par, chr(10)) AS ls FROM p)),
b AS (SELECT doc_id, 'line' AS kind, array_to_string(ls[i + 1 : i + {op7_licenses.LINES}], ' ') AS block FROM pl UNION ALL SELECT doc_id, 'paragraph', par FROM p),
bw AS (SELECT doc_id, kind, list_distinct(regexp_extract_all(block, '{word}')) AS ws FROM b),
hit AS (SELECT doc_id, label, max(len(list_intersect(ws, own)) / len(own)) AS containment FROM bw JOIN t USING (kind) WHERE len(list_intersect(ws, own)) >= need GROUP BY 1, 2),
base AS ({" UNION ALL ".join(cases)}),
nb AS (SELECT doc_id, count(*) AS n, min(start) AS f, max(start) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY 1),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM hit) GROUP BY 1),
best AS (SELECT doc_id, max(containment) AS c FROM hit GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word, coalesce(nb.labels, '') AS base_labels,
       coalesce(al.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM w LEFT JOIN nb USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN best USING (doc_id)"""


def mix_sql(block_chars: int = op8_mix.BLOCK_CHARS, slots: int = op8_mix.SLOTS, seed: int = op8_mix.SEED) -> str:
    """One window per source and a recursive walk over the blocks."""
    total = "(SELECT sum(w)::BIGINT FROM parts)"
    return f"""
WITH RECURSIVE r AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS src, length(coalesce(text, '')) AS n,
                            md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest FROM documents),
z AS (SELECT greatest({block_chars}, (sum(n)::BIGINT + {slots - 1}) // {slots})::BIGINT AS size FROM r),
o AS (SELECT *, (sum(n) OVER (PARTITION BY src ORDER BY digest ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS "offset" FROM r),
g AS (SELECT src, sqrt(sum(n)::DOUBLE) AS weight, sum(n)::BIGINT // (SELECT size FROM z) + 1 AS n FROM r GROUP BY src),
parts AS (SELECT src, n, greatest(round(weight / sum(weight) OVER () * {op8_mix.PARTS})::BIGINT, 1) AS w, row_number() OVER (ORDER BY src) AS i FROM g WHERE weight > 0),
s AS (SELECT list(w ORDER BY i) AS w, list(n ORDER BY i) AS n, {total} AS total, sum(n)::BIGINT AS steps FROM parts),
f(k, t, done, pick) AS (
  SELECT 0::BIGINT, -1::BIGINT, [0::BIGINT for x in w], 0::BIGINT FROM s WHERE len(w) > 0
  UNION ALL
  SELECT k + 1, now, [CASE WHEN i = p THEN done[i] + 1 ELSE done[i] END for i in range(1, len(done) + 1)], p FROM (
    SELECT *, list_min([((done[i] + 1) * total + w[i] - 1) // w[i] * 100000 + i for i in range(1, len(w) + 1) if done[i] < n[i] AND done[i] * total // w[i] <= now]) % 100000 AS p FROM (
      SELECT f.k, f.done, s.*, greatest(f.t + 1, list_min([f.done[i] * total // w[i] for i in range(1, len(w) + 1) if f.done[i] < n[i]])) AS now FROM f, s WHERE f.k < steps))),
plan AS (SELECT i, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY k) - 1 AS block FROM f JOIN parts ON i = pick),
b AS (SELECT o.*, w, i, "offset" // (SELECT size FROM z) AS block FROM o LEFT JOIN parts USING (src))
SELECT doc_id, source, "offset", b.block, b.block * {total} // w AS release, ((b.block + 1) * {total} + w - 1) // w AS deadline, plan.slot
FROM b LEFT JOIN plan ON plan.i = b.i AND plan.block = b.block"""


def quality_sql() -> str:
    """Measurements by regular expressions and windows over exploded words; rules and policy from the operator's tables."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(q.RULES))
    k = q.WINDOW
    win = " || ' ' || ".join(f"ws[i + {j}]" for j in range(1, k + 1))
    return f"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, {win} AS win FROM (SELECT doc_id, ws, unnest(range(len(ws) - {k - 1})) AS i FROM x WHERE len(ws) >= {k})),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
nrep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range({k})) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM x),
nl AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(nl.n, 0)::BIGINT AS n_lines, coalesce(nl.dup, 0)::BIGINT AS n_dup_lines, coalesce(nrep.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(body, '[\\x{{00}}-\\x{{40}}\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]', '', 'g'))::BIGINT AS n_letters
      FROM x LEFT JOIN nl USING (doc_id) LEFT JOIN nrep USING (doc_id)),
b AS (SELECT *, ({bits})::BIGINT AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & {q.mask('base')} <> 0 AS base_failed, bits & {q.mask('v2')} = 0 AS kept, bits FROM b"""


def conversations_sql() -> str:
    """Digests straight from the table."""
    escaped = lambda c: rf"regexp_replace({c}, '<(\\*)\|', '<\\\1|', 'g')"
    ends = "'<|im_end|><|im_start|>assistant ok'"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', {ends}), (-1, 1, 'assistant', {ends}))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || replace(replace({escaped("role")}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') || chr(10)
                  || {escaped("text")} || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


def search_sql(top: int = op11_lexical.TOP) -> str:
    """Every term of every document is joined with every item's terms."""
    term = r"[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{term}')) AS term FROM documents),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{term}')) AS term FROM benchmark) GROUP BY 1, 2),
lens AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY 1),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lens),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
m AS (SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM lens, total),
gain AS (SELECT tf.doc_id, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)) AS gain FROM tf JOIN w USING (term) JOIN m USING (doc_id)),
s AS (SELECT item_id, doc_id, sum(times * gain)::BIGINT AS score FROM gain JOIN q USING (term) GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {top}"""


def clusters_sql(k: int = op12_lloyd.K, rounds: int = op12_lloyd.ROUNDS, dims: int = op12_lloyd.DIMS, scale: int = op12_lloyd.SCALE, seed: int = op12_lloyd.SEED) -> str:
    """Whole distances over one long table of components, a pair of queries for each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT vec_id, c, sum((v.x - c{r}.x) * (v.x - c{r}.x))::BIGINT AS d FROM v JOIN c{r} ON v.j = c{r}.j GROUP BY 1, 2),
a{r} AS (SELECT vec_id, min(d) AS distance, arg_min(c, d * {k} + c) AS c FROM d{r} GROUP BY 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT a.c, v.j, floor(sum(v.x) / count(*))::BIGINT AS x FROM a{r} a JOIN v ON v.vec_id = a.vec_id GROUP BY 1, 2),
c{r + 1} AS (SELECT o.c, o.j, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m ON m.c = o.c AND m.j = o.j)""")
    last = rounds
    return f"""
WITH k AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dims} AND len([y for y in embedding if y IS NOT NULL AND isfinite(y)]) = {dims}),
v AS (SELECT vec_id, unnest(range({dims})) AS j, floor({scale} * unnest(e)::DOUBLE)::BIGINT AS x FROM k),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR)) - 1 AS c FROM k ORDER BY c LIMIT {k}),
c0 AS (SELECT f.c, v.j, v.x FROM f JOIN v USING (vec_id)),
{", ".join(steps)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{last} GROUP BY c),
i AS (SELECT c, sum(distance)::BIGINT AS cluster_inertia FROM a{last} GROUP BY c)
SELECT a.vec_id, a.c::INTEGER AS cluster, a.distance, i.cluster_inertia, (SELECT sum(distance)::BIGINT FROM a{last}) AS inertia, h.centroid_sha256
FROM a{last} a JOIN i ON i.c = a.c JOIN h ON h.c = a.c"""
