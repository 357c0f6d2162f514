"""Encoding a corpus with a public byte-level BPE vocabulary by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens whose paths are exactly the BPE encodings. It starts
as one state with a loop for each byte; each merge (u, v) adds a gadget in rank order: the arc v is taken from the
state behind u, and an arc uv is added that enters like u and leaves like v. A state is therefore known by the token
that led to it, and an arc t of state s is there if no gadget took it away. ``Automaton.arc`` answers that by
following the gadgets of s and t backwards in rank order, and keeps the answer in the transition table, so the part of
the table (a square of the vocabulary) that no text uses is never made; ``explicit_table`` makes it whole for a few
merges, as a check. Words are encoded left to right over a byte trie of the arc labels and the transition table.

Defined results: null and empty text give an empty list; blank text is encoded; text that looks like a special token
is plain text; repeated rows repeat. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the vocabulary file; a parameter of every function.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pattern that splits text before the merges (fixed value of the vocabulary).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Words whose encodings a worker keeps; beyond, the store is emptied and filled anew.
KEPT_WORDS = 400_000
#: Arcs whose presence is kept; more are found again.
KEPT_ARCS = 2_000_000


def _letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The tokenization automaton of a vocabulary file (JSON with a BPE model)."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        letters = _letters()
        ids: dict[str, int] = model["vocab"]
        size = max(ids.values()) + 1
        self.labels: list[bytes | None] = [None] * size
        self.rank = [-1] * size
        self.left = list(range(size))
        self.right = list(range(size))
        self.gadget: dict[tuple[int, int], int] = {}
        self.table: dict[tuple[int, int], bool] = {}
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node
        self.label_at: dict[int, int] = {}  # node -> token
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall
        for text, i in ids.items():
            if all(c in letters for c in text) and len(text) == 1:
                self._add(i, bytes([letters[text]]))
        for rank, pair in enumerate(model["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = ids[u], ids[v], ids[u + v]
            if self.labels[a] is None or self.labels[b] is None or self.labels[c] is not None:
                continue
            if not self._survives(a, b, rank):
                self.gadget[a, b] = rank
                continue  # no path had u then v any more: the merge adds no arc
            self.rank[c], self.left[c], self.right[c], self.gadget[a, b] = rank, a, b, rank
            self._add(c, self.labels[a] + self.labels[b])

    def _add(self, token: int, label: bytes) -> None:
        self.labels[token] = label
        node = 0
        for x in label:
            node = self.trie.setdefault(node << 8 | x, len(self.trie) + 1)
        self.label_at[node] = token

    def _survives(self, s: int, t: int, before: int) -> bool:
        """Whether state ``s`` has arc ``t`` after the gadgets of rank below ``before``."""
        rank, gadget = self.rank, self.gadget
        while True:
            if gadget.get((s, t), before) < before:
                return False
            if rank[s] > rank[t]:  # s left like its right part did, just before its gadget took an arc
                before, s = rank[s], self.right[s]
            elif rank[t] >= 0:  # t was entered like its left part, just after
                before, t = rank[t] + 1, self.left[t]
            else:
                return True

    def arc(self, s: int, t: int) -> bool:
        found = self.table.get((s, t))
        if found is None:
            if len(self.table) >= KEPT_ARCS:
                self.table.clear()
            found = self.table[s, t] = self._survives(s, t, len(self.rank) + len(self.gadget))
        return found

    def word(self, data: bytes) -> list[int]:
        """The labels of the one path that spells ``data``."""
        n = len(data)
        into: list[int] = [-1] * (n + 1)
        trie, label_at, arc, labels = self.trie, self.label_at, self.arc, self.labels
        for start in range(n):
            s = into[start]
            if start and s < 0:
                continue
            node = 0
            for end in range(start, n):
                node = trie.get(node << 8 | data[end])
                if node is None:
                    break
                t = label_at.get(node)
                if t is not None and into[end + 1] < 0 and (not start or arc(s, t)):
                    into[end + 1] = t
        out, at = [], n
        while at:
            t = into[at]
            out.append(t)
            at -= len(labels[t])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        words = self.words
        for w in self.split(text or ""):
            ids = words.get(w)
            if ids is None:
                if len(words) >= KEPT_WORDS:
                    words.clear()
                ids = self.word(w.encode("utf-8", "surrogatepass"))
                if len(w) < 64:
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text whose arcs are ``ids``: their labels one after another."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


def explicit_table(merges: list[tuple[int, int]]) -> np.ndarray:
    """arc[s, t] of the automaton of ``merges`` (parts are bytes 0-255 or 256 + number of an earlier merge), gadget by gadget."""
    size = 256 + len(merges)
    arc = np.zeros((size, size), bool)
    arc[:256, :256] = True
    for k, (u, v) in enumerate(merges):
        c = 256 + k
        if not arc[u, v]:
            continue
        leaves = arc[v, :c].copy()
        arc[u, v] = False
        arc[c, :c] = leaves
        arc[: c + 1, c] = arc[: c + 1, u]
    return arc


_COMPILED: dict[int, Automaton] = {}


def compiled(vocabulary: bytes) -> Automaton:
    key = hash(vocabulary)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Automaton(vocabulary)
    return _COMPILED[key]


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): each text as the ids of ``vocabulary``, without special tokens.

    The vocabulary file is read by the driver and broadcast; its size is that of a public vocabulary (a few MB).
    """
    source = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(source.value)
        for batch in batches:
            ids, ends = [], [0]
            for x in batch.column(1).to_pylist():
                ids += automaton.encode(x)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    return documents.select(F.col(key).cast("bigint"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, text): the texts of lists of ids; a null list gives an empty text."""
    source = encoded.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(source.value)
        for batch in batches:
            texts = [automaton.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(F.col(key).cast("bigint"), "ids").mapInArrow(run, f"{key} bigint, text string")
