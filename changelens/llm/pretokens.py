"""Pieces of text that a word-wise tokenizer encodes on their own, and what they encode to.

The tokenizers served here drop white space and never join across it, so the ids of a text are the ids
of its white-space separated chunks in a row. Special strings contain no white space. A chunk's comma or
full stop after an ASCII letter or digit is a word of its own too and is cut off, which leaves fewer distinct chunks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from itertools import chain, count

import numpy as np

_MARK = re.compile(rb"([a-z0-9])([.,])(?=[ \n])")
_KIND = bytes(97 if chr(i).isalnum() and i < 128 else 32 if i in b" \t\n\r\x0b\x0c" else i if i in b".," else 63 for i in range(256))
_JOINED = [a + b + b" " for a in (b"?", b".", b",") for b in (b".", b",")]


def chunks(text: bytes) -> list[bytes]:
    if b"<|" in text:  # special strings are matched before the text is lower-cased
        return text.split()
    text = text.lower()
    kinds = text.translate(_KIND)
    if any(j in kinds for j in _JOINED):
        text = _MARK.sub(rb"\1 \2", text)
    else:
        for mark in (b", ", b". ", b",\n", b".\n"):
            text = text.replace(mark, b" " + mark)
    return text.split()


#: A word of a-z and Latin-1 letters, in UTF-8, composed already and lower-cased letter by letter; then ASCII marks or nothing.
_WORD = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")


class Encoder:
    """A tokenizers file whose pre-tokens never span white space; words of Latin letters skip the normalizer and the splitter."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        if not any(s["type"] == "Lowercase" for s in steps) or not any(s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} for s in steps):
            raise ValueError(f"{path}: not a tokenizer that lower-cases and drops white space")
        self.full = Tokenizer.from_file(path)
        self.size = self.full.get_vocab_size()
        splits = spec["pre_tokenizer"] or {}
        splits = splits.get("pretokenizers", [splits])
        parts = [s["pattern"].get("Regex", "").split("|") for s in splits if s.get("type") == "Split"]
        self.latin = all(s["type"] in ("NFC", "Lowercase", "Replace") for s in steps) and any({r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= {*p} for p in parts)
        letters = [s for s in splits if s.get("type") == "ByteLevel"]
        split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *letters]}
        self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": split, "added_tokens": []}))
        vocabulary, suffix = self.words.get_vocab(), spec["model"].get("end_of_word_suffix")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def _words(self, found: list[bytes]) -> list[list[int]]:
        """All words in one text; a word ends at the id that carries the suffix."""
        ids = self.words.encode_batch_fast([b" ".join(found).decode().lower()], add_special_tokens=False)[0].ids
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(ends) != len(found):
            return self._texts(found)
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _texts(self, found: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.full.encode_batch_fast([c.decode() for c in found], add_special_tokens=False)]

    def encode(self, found: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(found)
        at, words, marks, rest = [], [], [], []
        for i, c in enumerate(found):
            if c.isalpha() and c.islower():
                at.append(i)
                words.append(c)
            elif self.latin and (m := _WORD.fullmatch(c)):
                at.append(i)
                words.append(m[1])
                if m[2]:
                    marks.append((i, m[2]))
            else:
                rest.append(i)
        for mine, lists in ((at, self._words(words)), (rest, self._texts([found[i] for i in rest]))):
            for i, ids in zip(mine, lists, strict=True):
                out[i] = ids
        distinct = list({m for _, m in marks})
        after = dict(zip(distinct, self._texts(distinct), strict=True))
        for i, m in marks:
            out[i] = out[i] + after[m]
        return out


#: Chunks that a Python process keeps beside the tasks of all later steps: about 50 MB. Most chunks stand in one text only.
KEPT = 200_000


class _Places(dict):
    """Chunks numbered in the order of their first sight; `new` holds those whose ids are not known yet."""

    def __init__(self, chunks: Iterable[bytes] = ()):
        super().__init__(zip(chunks, count()))
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self.new.append(chunk)
        n = self[chunk] = len(self)
        return n


class Memo:
    """Ids of the chunks seen by this Python process, kept across its tasks; above `most` chunks only the most used half of that stays."""

    def __init__(self, encoder: Encoder, most: int = KEPT):
        self.encoder, self.most = encoder, most
        self._fill([], np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _fill(self, found: list[bytes], flat: np.ndarray, lens: np.ndarray, hits: np.ndarray):
        self.place = _Places(found)
        self.starts, self.hits, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.n = self.n_ids = 0
        self._add(flat, lens, hits)

    def _add(self, flat: np.ndarray, lens: np.ndarray, hits: np.ndarray):
        n, k = self.n, len(lens)
        while n + k + 1 > len(self.starts):
            self.starts, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.hits))
        while self.n_ids + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.n_ids : self.n_ids + len(flat)] = flat
        self.starts[n : n + k + 1] = self.n_ids + np.concatenate([[0], np.cumsum(lens)])
        self.hits[n : n + k] = hits
        self.n, self.n_ids = n + k, self.n_ids + len(flat)

    def _learn(self):
        new, self.place.new = self.place.new, []
        for at in range(0, len(new), 4096):
            ids = self.encoder.encode(new[at : at + 4096])
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            self._add(np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())), lens, np.zeros(len(ids), np.int32))

    def _shrink(self):
        """Of chunks in equally many texts the later ones stay. Halved counts let those go that are no longer used."""
        kept = np.sort(np.argsort(self.hits[: self.n], kind="stable")[-(self.most // 2) :])
        found = list(self.place)
        self._fill([found[i] for i in kept.tolist()], *self._ids(kept), self.hits[kept] >> 1)

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks at these places in a row, and their number for each chunk."""
        lens = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lens)
        n = int(ends[-1]) if len(at) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(n)], lens

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.n > self.most:
            self._shrink()
        places = [np.fromiter(map(self.place.__getitem__, f), np.int64, len(f)) for f in map(chunks, texts)]
        self._learn()
        for at in places:
            self.hits[at] += 1
        return [self._ids(at)[0] for at in places]


_HELD: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    if path not in _HELD:
        _HELD[path] = Memo(Encoder(path))
    return _HELD[path]
