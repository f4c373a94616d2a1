"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding: lower case, look-alikes of other scripts and digits written for letters become the letter (i and l are one), invisible
characters go, everything that is neither letter nor digit is a gap. Entries are whole words (" idiot ") or
beginnings of words (" idio"), so an entry never matches inside a word.

The lexicon is learned from labelled rows: the beginnings and whole words of a bounded sample of both classes (TRAIN_ROWS, a
documented parameter) are counted by documents; an entry must occur in SUPPORT toxic documents and so much
more often there than in clean ones that chance does not explain it among all candidates (a bound by Bonferroni). Equal texts count
once, and entries are chosen greedily by the texts that earlier ones leave over. An entry weighs the log of its rates in toxic and clean documents.

A text's score is the logistic of the toxic share's log odds plus the weights of its distinct entries, each
less by the log of the text's length over the mean clean one (a long text meets an entry by chance more easily). Of the entries
that match one word the heaviest counts, and a word inside an exception phrase counts nothing.

Defined results: null and empty texts have no entries and the score of the toxic share; a row without id is not held out and never
labelled; a label above 0 is toxic, null labels are not read, of several labels of one id the highest counts, all rows with the id have it; without
labels of both classes the lexicon is empty and all scores are equal; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import map_rows, stored

#: Labelled rows of both classes together on which the lexicon is learned, chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Shortest and longest beginning of a word; toxic documents that an entry needs; entries expected by chance; entries at most,
#: and candidates (the surest) among which they are chosen.
SHORT, LONG, SUPPORT, CHANCE, MOST, CANDIDATES = 3, 12, 3, 0.05, 2000, 5000
TOXIC_FROM = 0.7
PIECE = 1 << 20
#: Letters of other scripts and signs that look like a Latin letter, and digits written for letters.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "@": "a", "$": "s",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "l": "i",
}
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ["trash can", "trash bag", "trash bin", "clown fish", "class clown", "sore loser", "kill time", "dumb bell", "hell of a"]


class _Fold(dict):
    """A translation table that learns each code point when it is first met: wide and small forms, marks and gaps."""

    def __missing__(self, point: int) -> str:
        import unicodedata

        c = chr(point)
        if 0xFF01 <= point <= 0xFF5E:  # full-width forms
            c = chr(point - 0xFEE0)
        low = c.lower()
        if unicodedata.category(c) in ("Cf", "Mn"):
            out = ""
        elif low in LOOK_ALIKES:
            out = LOOK_ALIKES[low]
        else:
            out = low if low.isalnum() else " "
        self[point] = out
        return out


_FOLD = _Fold()


def folded(text: bytes) -> Iterator[str]:
    """Pieces of the folded text, cut at white space, each with a gap at both ends and between its words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \n\t\r":
            end += 1
        words = text[at:end].decode("utf-8", "replace").translate(_FOLD).split()
        if words:
            yield " " + " ".join(words) + " "
        at = end


def parts(word: str) -> Iterable[str]:
    """The entries that match a word: its beginnings and the whole."""
    for n in range(SHORT, min(LONG, len(word)) + 1):
        yield " " + word[:n]
    yield " " + word + " "


def words_of(text: bytes) -> set[str]:
    out: set[str] = set()
    for p in folded(text):
        out.update(p.split())
    return out


@dataclass
class Lexicon:
    """Entries with their weights, the log odds of the toxic class and the mean length of clean texts in words."""

    weights: dict[str, float]
    prior: float
    length: float
    exceptions: list[str]

    def scorer(self) -> Callable[[bytes], tuple[float, int]]:
        """A function from a text to its score and the number of distinct entries."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for e, w in self.weights.items():
            automaton.add_word(e, (e, w))
        for phrase in self.exceptions:
            e = " " + " ".join(phrase.translate(_FOLD).split()) + " "
            if e not in self.weights:
                automaton.add_word(e, (e, None))
        if len(automaton):
            automaton.make_automaton()

        def score(text: bytes) -> tuple[float, int]:
            best: dict[str, float] = {}
            n = 0
            for p in folded(text):
                n += p.count(" ") - 1
                if not len(automaton):
                    continue
                found: dict[int, tuple[float, str]] = {}
                harmless: list[tuple[int, int]] = []
                for end, (e, w) in automaton.iter(p):
                    at = end - len(e) + 1
                    if w is None:
                        harmless.append((at, end))
                    elif at not in found or w > found[at][0]:
                        found[at] = (w, e)
                for at, (w, e) in found.items():
                    if not any(a <= at < b for a, b in harmless):
                        best[e] = w
            less = math.log(max(1.0, n / self.length))
            x = self.prior + sum(max(0.0, best[e] - less) for e in sorted(best))
            return 1 / (1 + math.exp(-x)) if x > -700 else 0.0, len(best)

        return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learned from."""
    rows = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))


def chance(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """A bound (Chernoff) on the probability that so large a share of an entry's documents is toxic when labels have nothing to do with it."""
    n, p = toxic + clean, n_toxic / (n_toxic + n_clean)
    q = toxic / n
    if q <= p:
        return 1.0
    apart = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)
    return math.exp(-n * apart)


def chosen(toxic: list[list[int]], clean: list[list[int]], names: list[str], n_toxic: int, n_clean: int, n_candidates: int) -> dict[str, float]:
    """The lexicon with its weights, from the candidates (places in `names`) of every sampled text that has some.

    Greedy: the surest entry over the texts that no chosen entry is in comes first (of equal ones the longest), until chance
    explains the rest. What only stands beside chosen entries follows if it is at least half as common as the rarest of them: synonyms
    are, the other words of a few texts and their near copies are not.
    A weight is the log of the entry's rates over all sampled texts. `names` are in the order of how sure they are.
    """
    rows = [sorted(set(r)) for r in [*toxic, *clean]]
    texts: list[list[int]] = [[] for _ in names]
    for i, r in enumerate(rows):
        for e in r:
            texts[e].append(i)
    first = [(sum(i < len(toxic) for i in t), sum(i >= len(toxic) for i in t)) for t in texts]
    left = np.array(first, np.int64).reshape(-1, 2)
    open_, free = np.ones(len(rows), bool), [n_toxic, n_clean]
    out: dict[str, float] = {}
    while len(out) < MOST and len(names) and min(free) > 0:
        sure = np.array([chance(t, c, *free) if t >= SUPPORT else 1.0 for t, c in left.tolist()])
        best = min(range(len(names)), key=lambda e: (sure[e], -len(names[e]), names[e]))
        if sure[best] * n_candidates >= CHANCE:
            break
        t, c = first[best]
        out[names[best]] = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        for i in texts[best]:
            if open_[i]:
                open_[i] = False
                free[i >= len(toxic)] -= 1
                left[rows[i], int(i >= len(toxic))] -= 1
    common = min((first[names.index(e)][0] for e in out), default=0) / 2
    for e, (t, c) in enumerate(first):  # the surest first
        if t >= common and len(out) < MOST and not any(names[e].startswith(x) or x.startswith(names[e].rstrip()) for x in out):
            out[names[e]] = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    return dict(sorted(out.items()))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, exceptions: list[str] = EXCEPTIONS) -> Lexicon:
    """The lexicon from the labelled rows that are not held out."""
    spark = docs.sparkSession
    known = stored(labelled(labels), "labelled")
    n = {bool(r.toxic): r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Lexicon({}, 0.0, 1.0, exceptions)
    share = {c: min(1.0, train_rows / 2 / k) for c, k in n.items()}
    bar = F.when(F.col("toxic"), int(share[True] * (1 << 20))).otherwise(int(share[False] * (1 << 20)))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < bar)  # about train_rows rows of two small columns
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = stored(rows.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("text").alias("text")), "training")  # copies count once

    def found_in(only: dict | None, names: dict[str, int] | None):
        """Counts of the candidates over the texts, or (with `names`) the named entries of every text that has some."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: Counter = Counter()
            for b in batches:
                lists = []
                for t in b.column("text").cast(pa.binary()).to_pylist():
                    n, found = 0, set()
                    for p in folded(t or b""):
                        words = p.split()
                        n += len(words)
                        found.update(words)
                    entries = {e for w in found for e in parts(w)}
                    if names is not None:
                        lists.append([names[e] for e in entries & names.keys()])
                        continue
                    held.update(entries if only is None else entries & only.value.keys())
                    held["texts"], held["words"] = held["texts"] + 1, held["words"] + n  # entries begin with a gap
                if names is not None:
                    lists = [x for x in lists if x]
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], ["entries"])
                elif len(held) > 400_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["entry", "n"])
                    held.clear()
            if names is None:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["entry", "n"])

        return run

    def counts(of: str, only: dict | None, least: int) -> dict[str, int]:
        n = rows.filter(of).select("text").mapInArrow(found_in(only, None), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
        return {r.entry: r.n for r in n.filter(f"n >= {least} OR entry IN ('texts', 'words')").collect()}

    found = counts("toxic", None, SUPPORT)  # of train_rows / 2 texts at most
    n_toxic = found.pop("texts", 0)
    found.pop("words", None)
    clean = counts("NOT toxic", spark.sparkContext.broadcast(found), 1)
    n_clean, n_words = clean.pop("texts", 0), clean.pop("words", 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, 0.0, 1.0, exceptions)
    sure = {e: chance(t, clean.get(e, 0), n_toxic, n_clean) for e, t in found.items()}
    names = sorted((e for e in found if sure[e] * len(found) < CHANCE), key=lambda e: (sure[e], -len(e), e))[:CANDIDATES]
    at = {e: i for i, e in enumerate(names)}
    lists = {c: [r.entries for r in rows.filter("toxic" if c else "NOT toxic").select("text").mapInArrow(found_in(None, at), "entries array<int>").collect()] for c in (True, False)}
    weights = chosen(lists[True], lists[False], names, n_toxic, n_clean, len(found))
    return Lexicon(weights, math.log(n[True] / n[False]), max(1.0, n_words / n_clean), exceptions)


def toxicity(docs: DataFrame, lexicon: Lexicon, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted, n_entries (distinct entries found) of every document."""

    def make():
        score = lexicon.scorer()

        def run(texts, batch):
            found = [score(t) for t in texts]
            return [batch.column("doc_id"), batch.column("held_out"), [s for s, _ in found], [n for _, n in found]]

        return run

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    scored = map_rows(rows, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, n_entries int")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxic_from).cast("int").alias("predicted"), "n_entries")
