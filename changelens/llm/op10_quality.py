"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; a policy is a named mask of bits, applied later by `bits & mask = 0`. Which rule costs how many
documents under a policy (its ablation) is a bitwise aggregation over the ledger, without texts.

Defined results: a null or empty text has no words and fails `few_words`; a null doc_id stays null;
repeated rows give one ledger row each; an empty table gives an empty ledger; extra columns are not read.
Texts are read whole, and the work per text is linear but for one sort of its word windows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import map_rows

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters")

#: Rule name and the failing condition over the measurements; the position is the rule's bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("few_letters", "2 * n_letters < word_chars"),
]
#: Policy versions: the rules whose failure rejects a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "short_words", "long_words", "symbols"],
    "v2": [name for name, _ in RULES],
}


def repeated_words(words: list) -> int:
    """How many words stand in a window of WINDOW words that occurs at least twice, first occurrences included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) ** WINDOW < 2**63:
        windows = ids[:n].copy()
        for k in range(1, WINDOW):
            windows = windows * len(number) + ids[k : n + k]
    else:  # renumber after each word, so that the numbers stay exact and small
        windows = ids[:n]
        for k in range(1, WINDOW):
            windows = np.unique(windows * len(number) + ids[k : n + k], return_inverse=True)[1]
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    if not equal.any():
        return 0
    starts = np.concatenate([order[1:][equal], order[:-1][equal]])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.unique(starts), 1)
    np.add.at(edge, np.unique(starts) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(byte[0x80:0xC0].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = int(byte[65:91].sum() + byte[97:123].sum() + byte[0xC0:].sum())  # any code point from U+0080 counts as one
    return (len(words), points - int(byte[list(_SPACE)].sum()), int(byte[list(SYMBOLS)].sum()),
            len(lines), len(lines) - len(set(lines)), repeated_words(words), letters)


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements, and `bits` with bit i set if rule i fails."""

    def make():
        def run(texts, batch):
            return [batch.column("doc_id"), *(zip(*map(measure, texts)) if texts else [[]] * len(MEASURES))]

        return run

    ids = docs.schema["doc_id"].dataType.simpleString()
    found = map_rows(docs.select("doc_id", "text"), make, f"doc_id {ids}, " + ", ".join(f"{m} long" for m in MEASURES))
    return found.withColumn("bits", reduce(Column.bitwiseOR, [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]))


def mask(policy: str) -> int:
    bit = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bit[name] for name in POLICIES[policy])


def apply_policy(found: DataFrame, policy: str) -> DataFrame:
    """The ledger with `kept` under a policy version."""
    return found.withColumn("kept", F.col("bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablation(found: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: how many documents fail it, and how many only it rejects.

    The second number is what leaving the rule out would keep. One aggregation of counts, nothing is exchanged but them.
    """
    hit = F.col("bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    rules = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    counts = [F.struct(F.lit(name).alias("rule"), F.count(F.when(hit.bitwiseAND(F.lit(b).cast("long")) != 0, 1)).alias("n_failed"),
                       F.count(F.when(hit == b, 1)).alias("n_only")) for name, b in rules]
    return found.agg(F.array(*counts).alias("r")).select(F.inline("r"))
