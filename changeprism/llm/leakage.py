"""Evaluation passages inside a corpus, whole or in part, whatever the layout and manner of writing.

Texts are read as plain words (markup, soft hyphens, line-end hyphens, width, accents, look-alike letters and case do
not count). Wu-Manber search over words: the patterns are all windows of WINDOW words of the passages; a block shift
table over word pairs skips positions where no pattern can end, suffix buckets select the patterns, direct comparison
confirms. Where two windows of one item follow each other in the order of its passage, the best-scoring chain of the
passage's words in their order is sought around them, with insertions, omissions and changed words paid for; runs of
MIN_PART equal words that follow one another in text and passage are joined, whatever was inserted between them. The item
leaks if MIN_WORDS words are held.

What is not found: passages that are changed so often that no two windows of three words stay whole. Of 100 passages of
24 to 60 words with one word changed in eight, six, five or four all are found, with one in three none.

Defined results: null, empty and wordless texts and passages match nothing; passages under MIN_WORDS words cannot be
matched; repeated documents repeat their distinct items; a null item id is an id like others, and of a repeated one every
passage counts. Whole texts are searched.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a passage that make a leak.
MIN_WORDS = 14
WINDOW, BLOCK = 3, 2
#: Words that may stand between two matched words of a text, and of a passage.
TEXT_GAP, PASSAGE_GAP = 10, 8
#: Cost of each word in a gap, and the least score per matched word.
GAP_COST, LEAST_SCORE = 0.3, 0.7
#: Items searched at once; more are searched in blocks, so what a task holds is bounded.
ITEMS_AT_ONCE = 20_000

#: Fewest equal words in a row of a part of a passage that is joined to others over any insertion.
MIN_PART = 7

_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_LINE_END = re.compile(r"(?<=[^\W\d_])[-‐‑­][ \t]*\r?\n[\s>#*/|]*(?=[^\W\d_])")
_DROP = re.compile("[­​-‏⁠﻿̀-ͯ*`~]")
_WORD = re.compile(r"[^\W_]+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+", re.ASCII)
_PLAIN_DROP = re.compile("[*`~]")
#: Cyrillic and Greek letters that look like Latin ones (fixed values).
_ALIKE = str.maketrans("аеорсухіјѕԁһӏАВЕКМНОРСТХУІЈЅοαερν", "aeopcyxijsdhlABEKMHOPCTXYIJSoaepv")


@lru_cache(200_000)
def _plain(word: str) -> tuple[str, ...]:
    """A word without accents, width and look-alike letters; signs that stand for several words give them all."""
    return tuple(_WORD.findall(_DROP.sub("", unicodedata.normalize("NFKD", word).translate(_ALIKE)).lower()))


def words(text: str | None) -> list[str]:
    """The words of ``text`` without regard to layout and manner of writing."""
    if not text:
        return []
    if "\n" in text:
        text = _LINE_END.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if text.isascii():
        return _PLAIN_WORD.findall(_PLAIN_DROP.sub("", text).lower())
    own = _WORD.findall(_DROP.sub("", text).lower())
    if "".join(own).isascii():
        return own
    return [x for w in own for x in ((w,) if w.isascii() else _plain(w))]


class WuManber:
    """Multi-pattern search over words with a block shift table and suffix buckets."""

    def __init__(self, passages: dict[int, list[str]]):
        self.passages = passages
        self.most = WINDOW - BLOCK + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], list[tuple[str, int, int]]] = defaultdict(list)
        for item, own in passages.items():
            for at in range(len(own) - WINDOW + 1):
                pattern = own[at : at + WINDOW]
                for end in range(BLOCK, WINDOW + 1):
                    block = tuple(pattern[end - BLOCK : end])
                    self.shift[block] = min(self.shift.get(block, self.most), WINDOW - end)
                self.bucket[tuple(pattern[-BLOCK:])].append((pattern[0], item, at))

    def search(self, text: list[str]) -> dict[int, list[tuple[int, int]]]:
        """By item, where (indexes of the first word in ``text`` and in the passage) a window of its passage occurs."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        shift, bucket, most, i, n = self.shift, self.bucket, self.most, WINDOW - 1, len(text)
        while i < n:
            block = (text[i - 1], text[i])
            step = shift.get(block, most)
            if step:
                i += step
                continue
            first = text[i - WINDOW + 1]
            for head, item, at in bucket[block]:
                if head == first:
                    found[item].append((i - WINDOW + 1, at))
            i += 1
        return found


def chain(text: list[str], places: dict[str, list[int]]) -> int:
    """Words of the passage (``places``: positions by word, descending) in the longest of the best-scoring chains that end at
    each pair of equal words; 0 if all are too loose."""
    pairs = [(i, j) for i, w in enumerate(text) for j in places.get(w, ())]
    score, count, best = [], [], 0
    for k, (i, j) in enumerate(pairs):
        s, c = 1.0, 1
        for q in range(k - 1, -1, -1):
            a, b = pairs[q]
            if i - a > TEXT_GAP:
                break
            if a < i and b < j <= b + PASSAGE_GAP:
                x = score[q] + 1 - GAP_COST * max(i - a - 1, j - b - 1)
                if x > s:
                    s, c = x, count[q] + 1
        score.append(s)
        count.append(c)
        if c > best and s >= LEAST_SCORE * c:
            best = c
    return best


def joined(windows: list[tuple[int, int]]) -> int:
    """Most words in runs of MIN_PART equal words or more, made of ``windows`` (first word in text and in passage), that follow
    one another in both, whatever stands between them."""
    length: dict[tuple[int, int], int] = {}
    for i, j in windows:  # by text; a window right behind another makes its run longer
        length[i, j] = length.pop((i - 1, j - 1), WINDOW - 1) + 1
    runs = sorted((i + WINDOW - n, i + WINDOW, j + WINDOW - n, j + WINDOW) for (i, j), n in length.items() if n >= MIN_PART)
    best: list[int] = []
    for k, (a, z, c, e) in enumerate(runs):
        best.append(z - a + max((best[q] for q in range(k) if runs[q][1] <= a and runs[q][3] <= c), default=0))
    return max(best, default=0)


class Leaks:
    """Items of an evaluation set in texts."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [k for k, _ in items]
        passages = {k: words(p) for k, (_, p) in enumerate(items)}
        self.machine = WuManber({k: p for k, p in passages.items() if len(p) >= MIN_WORDS})
        self.places: dict[int, dict[str, list[int]]] = {}
        for k, p in self.machine.passages.items():
            at = self.places[k] = {}
            for j in range(len(p) - 1, -1, -1):
                at.setdefault(p[j], []).append(j)

    def of(self, text: str | None) -> list[tuple[int | None, int]]:
        """(item, words held) of the items that ``text`` leaks."""
        own = words(text)
        held: dict[int | None, int] = {}
        for item, at in self.machine.search(own).items():
            if len(at) < 2:
                continue
            reach, most, a = len(self.machine.passages[item]) + TEXT_GAP, 0, 0
            while a < len(at):
                z, low, follows = a, at[a][1], False
                while z + 1 < len(at) and at[z + 1][0] - at[z][0] <= reach:
                    z += 1
                    follows |= at[z][1] > low  # behind another window in text and passage
                    low = min(low, at[z][1])
                if follows:  # one window alone cannot be part of MIN_WORDS words with small changes
                    x, y = max(0, at[a][0] - reach), at[z][0] + WINDOW + reach
                    most = max(most, chain(own[x:y], self.places[item]))
                a = z + 1
            if most < MIN_WORDS:
                most = joined(at)
            if most >= MIN_WORDS:
                key = self.ids[item]
                held[key] = max(held.get(key, 0), most)
        return list(held.items())


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, held): the items whose passage a document holds in part or whole, with the words held.

    ``items``: (item_id, passage), a stated set of queries. It is searched in blocks of ITEMS_AT_ONCE items, each of
    which is sent to every task.
    """
    spark = documents.sparkSession
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("passage").cast("string").alias("passage")).where("passage IS NOT NULL").distinct()
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    schema = "doc_id bigint, item_id bigint, held int"
    first = items.limit(ITEMS_AT_ONCE + 1).collect()
    blocks = 1 if len(first) <= ITEMS_AT_ONCE else -(-items.count() // (ITEMS_AT_ONCE // 2))
    out = None
    for block in range(blocks):
        own = first if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast([(r.item_id, r.passage) for r in own])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            leaks = Leaks(sent.value)
            for batch in batches:
                rows = [(k, i, n) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, n in leaks.of(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())],
                    ["doc_id", "item_id", "held"],
                )

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
