"""Language identification by fusing evidence.

Four kinds of evidence meet in one posterior per row, by Bayes' rule over the languages and `und`:

- text: byte trigrams under naive Bayes models, one for every label of the table, each fitted on a sample of at most about
  LABEL_ROWS of its rows (a parameter; everything else covers all rows), tempered so that a long text does not drown the rest;
  `und` is a uniform model, which fits text of no known language best;
- markup: the declared language, with P(declared | language) counted over all rows;
- address: the top-level suffix, with P(suffix | language) counted over all rows;
- host: a prior from the host's other rows, smoothed by those of its domain, and these by all rows.

All counts are grouped sums of the rows' text posteriors, a row's own share left out of its prior. Sums are formed per
task first, so a hot host is one small row before it is exchanged; the table of hosts is joined back by
host: by broadcast up to BROADCAST_HOSTS hosts, else by an exchange in which Spark splits a hot host.

Defined results: a text without letters (null and empty ones too) is `und` with confidence 1 and not accepted; a null or
unknown declaration, suffix or host is no evidence; without labelled rows all is `und`; repeated rows each
get a result; empty tables give no rows; extra columns pass through `keep_known` and are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.llm.common import map_rows, packed, stored

LABEL_ROWS = 1000
FEATURES = 1 << 15
PART_BYTES = 2 << 20
#: Hosts up to which their table (three arrays of a number per class each) is broadcast.
BROADCAST_HOSTS = 20_000
#: Trigrams after which more text adds little; strength of the smoothing in rows; weight of a class in unseen data.
TEMPER, STRENGTH, REJECT = 200.0, 5.0, 0.5
UND = "und"
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_BLANK = (32 << 10 ^ 32 << 5 ^ 32) & (FEATURES - 1)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts in a row, and where each text's begin; blank trigrams carry no weight.

    Two blanks stand before a text and one behind it, so no trigram of a text reaches the letters of the next.
    """
    joined = b"".join(b"  " + t.translate(_FOLD) + b" " for t in texts) + b"  "
    a = np.frombuffer(joined, np.uint8).astype(np.int32)
    starts = np.cumsum([0, *(len(t) + 3 for t in texts)])
    return (a[:-2] << 10 ^ a[1:-1] << 5 ^ a[2:]) & (FEATURES - 1), starts


@dataclass
class Model:
    """Languages, `und` last, and the log likelihood of each feature by language."""

    languages: list[str]
    loglik: np.ndarray

    def posterior(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods (rows x classes) and whether a text has letters."""
        seen, score = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.loglik)))
        ends = np.cumsum([len(t) for t in texts])
        at = 0
        while at < len(texts):  # some texts at a time bound the arrays of features
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
            h, starts = features(texts[at:end])
            seen[at:end] = np.add.reduceat(h != _BLANK, starts[:-1], dtype=np.int64)
            for i, row in enumerate(self.loglik):
                score[at:end, i] = np.add.reduceat(row[h], starts[:-1], dtype=np.float64)
            at = end
        return score / (1 + seen / TEMPER)[:, None], seen > 0


def fit(labelled: DataFrame, label_rows: int = LABEL_ROWS) -> Model:
    """A model of every label (column lang) on about `label_rows` of its rows, chosen by a hash of the id."""
    rows = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each label
    names = sorted(sizes)
    bars = [x for name in names for x in (F.lit(name), F.lit(int(min(1.0, label_rows / sizes[name]) * (1 << 20))))]
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(F.create_map(*bars), F.col("lang"))) if names else rows

    def make():
        def run(texts, batch):
            langs, out = batch.column("lang").to_pylist(), []
            for i, name in enumerate(names):
                n = np.bincount(features([t for t, x in zip(texts, langs, strict=True) if x == name])[0], minlength=FEATURES)
                n[_BLANK] = 0
                at = np.flatnonzero(n)
                out.append((np.full(len(at), i, np.int32), at.astype(np.int32), n[at].astype(np.int64)))
            return [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)] if out else None

        return run

    def packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("lang").to_numpy(zero_copy_only=False).astype(np.int64) * FEATURES + b.column("feature").to_numpy(zero_copy_only=False)
            n = b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()]), pa.array([n.tobytes()])], ["cells", "counts"])

    counts = np.zeros((len(names), FEATURES))
    found = map_rows(rows.select("text", "lang"), make, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    for r in found.mapInArrow(packed_counts, "cells binary, counts binary").collect():  # FEATURES cells for each label at most
        counts.flat[np.frombuffer(r.cells, np.int64)] = np.frombuffer(r.counts, np.int64)
    loglik = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * FEATURES))
    loglik = np.concatenate([loglik, np.full((1, FEATURES), -np.log(FEATURES))]).astype(np.float32)
    loglik[:, _BLANK] = 0
    return Model([*names, UND], loglik)


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (its last label) of a url, null where it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    return host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"([^.]+)$", 1)


def declared(html: Column) -> Column:
    """The primary language that the html tag declares, null where it declares none."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,8})", 1))
    return F.when(found != "", found)


def visible(html: Column) -> Column:
    """Text of a page without scripts, styles, comments, tags and entities."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")


def text_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """The rows without their text, with `score` (tempered log likelihoods) and `has_text`."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    schema = rows.drop("text").schema.add("score", T.ArrayType(T.DoubleType())).add("has_text", T.BooleanType())

    def make():
        def run(texts, batch):
            score, has = model.posterior(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * score.shape[1]), pa.array(score.ravel().astype(np.float64)))
            return [*(batch.column(f.name) for f in others), lists, pa.array(has)]

        return run

    return map_rows(rows, make, schema)


def _share(logs: str) -> Column:
    """Probabilities from an array column of log weights."""
    parts = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(F.array(parts), lambda p: F.transform(p, lambda x: x / _mass(p)))[0]


def _mass(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def fuse(scored: DataFrame, model: Model) -> DataFrame:
    """Add language, confidence, accepted and text_language to a stored table of text_evidence.

    The table has the columns declared, suffix, domain and host (any may be null) beside score and has_text.
    """
    n = len(model.languages)
    zero = F.array(*[F.lit(0.0)] * n)
    scored = scored.withColumn("own", F.when(F.col("has_text"), _share("score")).otherwise(zero))
    sums = [F.sum(F.col("own")[i]) for i in range(n)]
    known = F.when(F.col("declared").isin(model.languages[:-1]), F.col("declared"))
    by_markup = {r[0]: [x or 0.0 for x in r[1:]] for r in scored.groupBy(known.alias("d")).agg(*sums).collect()}
    total = [sum(x[i] for x in by_markup.values()) for i in range(n)]
    told = [sum(x[i] for k, x in by_markup.items() if k) for i in range(n)]
    rates = {}
    for d in model.languages[:-1]:
        usual = [0.9 if x == d else 0.1 / max(1, n - 1) for x in model.languages]
        rates[d] = [(by_markup.get(d, [0.0] * n)[i] + STRENGTH * usual[i]) / (told[i] + STRENGTH) for i in range(n)]
    lits = lambda values: F.array(*[F.lit(float(x)) for x in values])
    markup = F.create_map(*[x for d, r in rates.items() for x in (F.lit(d), lits(r))]) if rates else F.lit(None).cast("map<string,array<double>>")

    def grouped(name: str, counts: str) -> DataFrame:
        return scored.filter(F.col(name).isNotNull()).groupBy(name).agg(F.array(*sums).alias(counts))

    hosts = scored.filter("host IS NOT NULL").groupBy("host").agg(F.array(*sums).alias("nh"), F.min("domain").alias("domain"), F.min("suffix").alias("suffix"))
    hosts = hosts.join(grouped("domain", "nd"), "domain", "left").join(grouped("suffix", "ns"), "suffix", "left").select("host", "nh", "nd", "ns")
    hosts = stored(hosts, "hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)  # else Spark joins by host and splits a hot one
    rows = scored.join(hosts, "host", "left").withColumn("markup", F.try_element_at(markup, F.col("declared")))
    for c in ("nh", "nd", "ns"):  # a row's own share is left out
        rows = rows.withColumn(c, F.transform(F.arrays_zip(F.col(c).alias("c"), F.col("own").alias("own")), lambda x: F.greatest(x["c"] - x["own"], F.lit(0.0))))
    rows = rows.withColumns({f"m{c}": _mass(F.col(c)) for c in ("nh", "nd", "ns")})
    base, all_ = lits([(x + 1) / (sum(total) + n) for x in total]), lits(total)

    def log_of(score: Column, i: Column) -> Column:
        p_domain = F.coalesce((F.get("nd", i) + STRENGTH * F.get(base, i)) / (F.col("mnd") + STRENGTH), F.get(base, i))
        prior = F.coalesce((F.get("nh", i) + STRENGTH * p_domain) / (F.col("mnh") + STRENGTH), F.get(base, i))
        suffix = (F.get("ns", i) + STRENGTH * (F.col("mns") + 1) / (sum(total) + 1)) / (F.get(all_, i) + STRENGTH)
        return score + F.log(prior) + F.log(F.coalesce(suffix, F.lit(1.0))) + F.log(F.coalesce(F.get("markup", i), F.lit(1.0)))

    rows = rows.withColumn("logs", F.transform("score", log_of)).withColumn("post", _share("logs"))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda a: F.get(names, F.array_position(a, F.array_max(a)).cast("int") - 1)
    rows = rows.withColumns({
        "language": F.when(F.col("has_text"), best(F.col("post"))).otherwise(UND),
        "confidence": F.when(F.col("has_text"), F.array_max("post")).otherwise(1.0),
        "accepted": F.col("has_text") & (F.get("post", F.lit(n - 1)) < REJECT),
        "text_language": F.when(F.col("has_text"), best(F.col("score"))).otherwise(UND),
    })
    return rows.drop("score", "own", "nh", "nd", "ns", "mnh", "mnd", "mns", "markup", "logs", "post")


def identify(documents: DataFrame, pages: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """Documents (their source is the host) and pages (url and html) in one table.

    doc_id, page_id, declared, suffix, domain, host, has_text, language, confidence, accepted, text_language.
    """
    model = fit(documents, label_rows)
    none = F.lit(None).cast("string")
    host, domain, suffix = address(F.col("url"))
    rows = documents.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), none.alias("suffix"), none.alias("domain"), F.concat(F.lit("source:"), "source").alias("host"))
    rows = rows.union(pages.select(F.lit(None).cast("long"), "page_id", visible(F.col("html")), declared(F.col("html")), suffix, domain, host))
    return fuse(stored(text_evidence(rows, model), "evidence"), model)


def keep_known(documents: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """The accepted documents with all their columns."""
    model = fit(documents, label_rows)
    none = F.lit(None).cast("string")
    rows = packed(documents, text=F.col("text"), declared=none, suffix=none, domain=none, host=F.concat(F.lit("source:"), F.col("source")))
    return fuse(stored(text_evidence(rows, model), "evidence"), model).filter("accepted").select("row.*")
