"""Deeply nested JSON text to linked flat rows by vectorised structural indexing.

The texts of an Arrow batch are laid end to end in one byte array. Bitmaps of escapes, quotes, brackets and delimiters
are built for the whole array at once, what lies inside strings is masked by quote parity, nesting depth is the prefix
sum of the brackets, and enclosing brackets, array positions and key spans come from binary searches over (depth,
position). The same bitmaps tell whether a text is complete JSON: each token is checked against the one before it and
the bracket around it, numbers and words by one pattern over what lies between, escapes and control characters by their
bytes. Strings that hold JSON become texts of the next round, as many rounds as there are levels, and their rows are
linked into the place of the string. No JSON value is materialised but the text of such a string.

Defined results: null, empty, blank and incomplete JSON give no rows. A text whose value is a string of JSON is read
through, at any level. A null id gives rows with a null record_id. An input row that is repeated repeats its rows.
Nested arrays index as ``a[0][1]``; the array at the root as ``[0]``. Of a repeated key every value counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text indexed at once; a longer single text is indexed alone.
BLOCK_BYTES = 1 << 20

#: Kinds of tokens.
_OBJECT, _ARRAY, _END_OBJECT, _END_ARRAY, _COMMA, _COLON, _STRING, _PLAIN = range(1, 9)
_KIND = np.zeros(256, np.uint8)
for _c, _k in zip(b"{[}],:", range(1, 7), strict=True):
    _KIND[_c] = _k
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 13]] = True
_AFTER_ESCAPE = np.zeros(256, bool)
_AFTER_ESCAPE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_IS_VALUE = np.zeros(9, bool)
_IS_VALUE[[_OBJECT, _ARRAY, _STRING, _PLAIN]] = True

_BAD_PLAIN = re.compile(rb"(?:^|(?<=\n))(?!(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)\n)[^\n]")
#: The beginning of a string that may hold JSON.
_INNER = re.compile(rb'(?: |\\[nrt]|\\u00(?:20|09|0[aAdD]))*(?:[\[{]|\\"|\\u00(?:5[bB]|7[bB]|22))')


class StructuralIndex:
    """What stands in texts of JSON laid end to end: brackets and strings that may hold JSON (entries), in order.

    Of each entry: its text (doc), the entry of the bracket around it (parent, -1 at the root), whether that is an array,
    its place there (slot), and the span of its key. ``valid`` tells which texts are complete.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        b = np.frombuffer(self.data, np.uint8)
        n, docs = len(b), len(texts)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]).astype(np.int64)
        ends = starts + np.array([len(t) for t in texts], np.int64)
        bad = np.zeros(docs, bool)

        def doc_of(at: np.ndarray) -> np.ndarray:
            return np.searchsorted(starts, at, side="right") - 1

        # escapes: every other backslash of a run
        back = np.flatnonzero(b == 92)
        count = np.arange(len(back))
        first = np.r_[True, np.diff(back) != 1][: len(back)]
        escape = back[(count - np.maximum.accumulate(np.where(first, count, 0))) % 2 == 0] if len(back) else back
        escaped = np.zeros(n + 1, bool)
        escaped[escape + 1] = True
        # strings: quotes by parity within their text
        q = np.flatnonzero(b == 34)
        q = q[~escaped[q]]
        before = np.searchsorted(q, starts)
        counts = np.searchsorted(q, ends) - before
        bad |= counts % 2 == 1
        opening = (np.arange(len(q)) - before[doc_of(q)]) % 2 == 0 if len(q) else np.zeros(0, bool)
        step = np.zeros(n + 1, np.int8)
        step[q[opening]] = 1
        step[q[~opening]] = -1
        odd = np.flatnonzero(counts % 2 == 1)
        step[ends[odd]] -= 1
        inside = np.cumsum(step[:n], dtype=np.int8) > 0  # the opening quote included
        outside = ~inside
        closing = np.zeros(n, bool)
        closing[q[~opening]] = True
        # tokens
        kind = np.where(outside, _KIND[b], 0)
        plain = outside & (kind == 0) & ~_BLANK[b] & ~closing
        kind[q[opening]] = _STRING
        plain_start = plain & ~np.r_[False, plain[:-1]]
        kind[plain_start] = _PLAIN
        tok = np.flatnonzero(kind)
        ty = kind[tok]
        tdoc = doc_of(tok)
        turn = ((ty <= _ARRAY).astype(np.int64)) - ((ty == _END_OBJECT) | (ty == _END_ARRAY))
        total = np.cumsum(turn)
        at0 = np.searchsorted(tok, starts)
        depth = total - np.where(at0 > 0, np.r_[0, total][at0], 0)[tdoc] if len(tok) else total
        end = np.searchsorted(tok, ends)
        bad |= end == at0  # no token
        some = end > at0
        bad[some] |= depth[end[some] - 1] != 0
        bad[tdoc[depth < 0]] = True
        is_open = ty <= _ARRAY
        is_close = (ty == _END_OBJECT) | (ty == _END_ARRAY)
        # the bracket around each token, of a closing one its own: the last that opened at that depth
        around = depth - is_open + is_close
        big = n + 1
        opens = np.flatnonzero(is_open)
        keys = depth[opens] * big + tok[opens]
        order = np.argsort(keys, kind="stable")
        found = np.searchsorted(keys[order], around * big + tok) - 1
        held = np.where((around > 0) & (found >= 0), opens[order[np.maximum(found, 0)]] if len(opens) else 0, -1)
        context = np.where(held >= 0, ty[np.maximum(held, 0)], 0) if len(tok) else ty
        # grammar
        lead = np.r_[True, tdoc[1:] != tdoc[:-1]][: len(tok)]
        prev = np.where(lead, 0, np.r_[0, ty[:-1]][: len(tok)])
        value = _IS_VALUE[ty]
        is_key = (ty == _STRING) & (context == _OBJECT) & ((prev == _OBJECT) | (prev == _COMMA))
        prev_key = np.r_[False, is_key[:-1]][: len(tok)] & ~lead
        prev_value = ((prev == _END_OBJECT) | (prev == _END_ARRAY) | (prev == _STRING) | (prev == _PLAIN)) & ~prev_key
        as_value = (lead & (context == 0)) | (prev == _COLON) | ((context == _ARRAY) & ((prev == _ARRAY) | (prev == _COMMA)))
        good = np.where(value, is_key | as_value, False)
        good |= (ty == _COLON) & prev_key
        good |= (ty == _COMMA) & prev_value & (context > 0)
        good |= (ty == _END_OBJECT) & (context == _OBJECT) & (prev_value | (prev == _OBJECT))
        good |= (ty == _END_ARRAY) & (context == _ARRAY) & (prev_value | (prev == _ARRAY))
        bad[tdoc[~good]] = True
        # numbers and words
        keep = plain | (np.r_[False, plain[:-1]] & ~plain)
        words = np.where(plain, b, 10)[keep].tobytes()
        if len(words):
            place = np.flatnonzero(keep)
            for m in _BAD_PLAIN.finditer(words):
                bad[doc_of(place[m.start()])] = True
        # escapes and control characters
        bad[doc_of(np.flatnonzero(inside & (b < 32)))] = True
        esc = escape[inside[escape]]
        wide = np.r_[b, np.zeros(6, np.uint8)]
        nxt = wide[esc + 1]
        wrong = ~_AFTER_ESCAPE[nxt]
        u = nxt == 117
        wrong |= u & ~(_HEX[wide[esc + 2]] & _HEX[wide[esc + 3]] & _HEX[wide[esc + 4]] & _HEX[wide[esc + 5]])
        bad[doc_of(esc[wrong])] = True
        self.valid = ~bad

        # entries
        strings = np.flatnonzero((ty == _STRING) & ~is_key & self.valid[tdoc])
        head = wide[tok[strings] + 1]
        may = strings[(head == 123) | (head == 91) | (head == 92) | (head == 32)]
        inner = np.array([i for i in may.tolist() if _INNER.match(self.data, int(tok[i]) + 1)], np.int64)
        entry = np.sort(np.r_[opens[self.valid[tdoc[opens]]], inner])
        number = np.full(len(tok) + 1, -1, np.int64)
        number[entry] = np.arange(len(entry))
        pos = tok[entry]
        self.doc = tdoc[entry]
        self.is_object = ty[entry] == _OBJECT
        self.is_string = ty[entry] == _STRING
        up = held[entry] if len(entry) else entry
        self.parent = np.where(up >= 0, number[up], -1)
        self.in_array = (context[entry] == _ARRAY) if len(entry) else np.zeros(0, bool)
        comma = np.flatnonzero(ty == _COMMA)
        commas = np.sort(depth[comma] * big + tok[comma])
        level = around[entry] * big
        self.slot = np.searchsorted(commas, level + pos) - np.searchsorted(commas, level + tok[np.maximum(up, 0)]) if len(entry) else entry
        keyed = (context[entry] == _OBJECT) if len(entry) else np.zeros(0, bool)
        key = tok[np.maximum(entry - 2, 0)] if len(entry) else entry
        stop = q[np.minimum(np.searchsorted(q, key) + 1, max(len(q) - 1, 0))] if len(q) else key
        self.key_from = np.where(keyed, key + 1, -1)
        self.key_to = np.where(keyed, stop, -1)
        self._pos, self._q = pos, q
        self._names: dict[bytes, str] = {}

    def key(self, i: int) -> str | None:
        """The key of an entry as written; None without one."""
        a = self.key_from[i]
        if a < 0:
            return None
        raw = self.data[a : self.key_to[i]]
        name = self._names.get(raw)
        if name is None:
            name = self._names[raw] = json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode("utf-8", "surrogatepass")
        return name

    def text(self, i: int) -> bytes:
        """What the string of an entry holds."""
        a = int(self._pos[i])
        raw = self.data[a : int(self._q[np.searchsorted(self._q, a) + 1]) + 1]
        return raw[1:-1] if b"\\" not in raw else json.loads(raw).encode("utf-8", "surrogatepass")


class NestedIndex:
    """Structural indexes of texts and, round by round, of the JSON that their strings hold."""

    def __init__(self, texts: list[bytes]):
        self.rounds: list[tuple[StructuralIndex, np.ndarray]] = []
        origin = np.full(len(texts), -1, np.int64)
        while texts:
            index = StructuralIndex(texts)
            self.rounds.append((index, origin))
            origin = np.flatnonzero(index.is_string)
            texts = [index.text(i) for i in origin.tolist()]

    def keys_of_object_arrays(self) -> Iterator[tuple[int, str]]:
        """(text number, key) of arrays that hold an object, each at least once."""
        above: list[tuple[list[int], list[str | None], list[int]]] = []  # of each round: text, key, array around, by entry if needed
        for r, (ix, origin) in enumerate(self.rounds):
            tops = np.arange(len(origin)) if r == 0 else self._tops[origin]
            self._tops = tops[ix.doc] if len(ix.doc) else ix.doc
            above.append((self._tops, ix, origin))
            for i in np.unique(ix.parent[ix.is_object & ix.in_array]).tolist():
                yield from self._named(above, r, i)
            if r:  # a string that is an element and holds an object
                for i in np.flatnonzero((ix.parent < 0) & ix.is_object).tolist():
                    place = self._element(above, r, i)
                    if place is not None:
                        yield from self._named(above, *place)

    @staticmethod
    def _named(above: list, r: int, i: int) -> Iterator[tuple[int, str]]:
        """(text, key) of an array, which may be what a string under that key holds."""
        top = int(above[r][0][i])
        while above[r][1].parent[i] < 0 and r:
            i, r = int(above[r][2][above[r][1].doc[i]]), r - 1
        name = above[r][1].key(i)
        if name is not None:
            yield top, name

    @staticmethod
    def _element(above: list, r: int, i: int) -> tuple[int, int] | None:
        """(round, entry) of the array of which the string that holds a root is an element."""
        while above[r][1].parent[i] < 0 and r:
            i, r = int(above[r][2][above[r][1].doc[i]]), r - 1
        ix = above[r][1]
        return (r, int(ix.parent[i])) if ix.in_array[i] else None

    def nodes(self, array_keys) -> Iterator[tuple[int, str, str]]:
        """(text number, parent_path, node_path) of each object that is an element of an array.

        An object directly under a key for which ``array_keys`` (text number, key) holds is an array of one. Paths are made
        for elements only, from the nearest one above, so depth alone costs nothing.
        """
        paths: list[str] = []  # of elements
        last: list[tuple] = []  # of the round before, by entry: text, element above, bracket before it and step, in array, key
        for r, (ix, origin) in enumerate(self.rounds):
            rows: list[tuple] = []
            for i, (doc, up, is_object, in_array, slot) in enumerate(zip(ix.doc.tolist(), ix.parent.tolist(), ix.is_object.tolist(), ix.in_array.tolist(), ix.slot.tolist(), strict=True)):
                if up >= 0:
                    top, over, chain = rows[up][0], rows[up][1], rows[up][2]
                    name = None if in_array else ix.key(i)
                    chain = (chain, f"[{slot}]" if in_array else f".{name}")
                elif r:
                    top, over, chain, in_array, name = last[origin[doc]]
                else:
                    top, over, chain, in_array, name = doc, -1, None, False, None
                if is_object and (in_array or (name is not None and array_keys(top, name))):
                    steps = [] if in_array else ["[0]"]
                    link = chain
                    while link is not None:
                        steps.append(link[1])
                        link = link[0]
                    base = paths[over] if over >= 0 else ""
                    path = base + "".join(reversed(steps))
                    if not base and path[:1] == ".":
                        path = path[1:]
                    yield top, base, path
                    over, chain = len(paths), None
                    paths.append(path)
                rows.append((top, over, chain, in_array, name))
            last = rows


def _bytes(text: str | None) -> bytes | None:
    """The bytes to index for ``text``; None if it cannot be a JSON container."""
    return text.lstrip("﻿").encode("utf-8", "surrogatepass") if text else None


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[list[int], list[bytes]]]:
    rows, texts, size = [], [], 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        body = _bytes(text)
        if body is None:
            continue
        rows.append(i)
        texts.append(body)
        size += len(body)
        if size >= BLOCK_BYTES:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _array_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[str, str]] = set()
    for batch in batches:
        places = batch.column("place").to_pylist()
        for rows, texts in _blocks(batch, "value"):
            fresh = {(places[rows[d]], k) for d, k in NestedIndex(texts).keys_of_object_arrays()} - seen
            if len(seen) < 1_000_000:  # what is not kept is only sent again
                seen |= fresh
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in fresh]), pa.array([k for _, k in fresh])], ["place", "key"])


def object_array_keys(values: DataFrame) -> DataFrame:
    """(place, key): keys under which some text of ``values`` (place, id, value) holds an array of objects."""
    return values.select("place", "value").mapInArrow(_array_keys, "place string, key string").distinct()


_ROWS = "place string, record_id bigint, parent_path string, node_path string"


def _emit(places: list, ids: list, out: list[tuple[int, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([places[i] for i, _, _ in out], pa.string()), pa.array([ids[i] for i, _, _ in out], pa.int64()), pa.array([p for _, p, _ in out], pa.string()), pa.array([n for _, _, n in out], pa.string())],
        ["place", "record_id", "parent_path", "node_path"],
    )


def object_rows(values: DataFrame, array_keys: dict[str, frozenset[str]]) -> DataFrame:
    """(place, record_id, parent_path, node_path) of each object that is an element of an array in ``values``.

    ``values``: (place string, id bigint, value string). ``array_keys``: by place, the keys whose lone objects are
    arrays of one (see ``object_array_keys``); a place that is absent has none.
    """
    none: frozenset[str] = frozenset()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ids = batch.column("place").to_pylist(), batch.column("id").to_pylist()
            for number, texts in _blocks(batch, "value"):
                own = [array_keys.get(places[i], none) for i in number]
                out = [(number[d], p, n) for d, p, n in NestedIndex(texts).nodes(lambda d, k, own=own: k in own[d])]
                if out:
                    yield _emit(places, ids, out)

    return values.select("place", "id", "value").mapInArrow(rows, _ROWS)


def _lone_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, text, key): keys of lone objects of each text."""
    for batch in batches:
        places, shas = batch.column("place").to_pylist(), batch.column("text").to_pylist()
        for number, texts in _blocks(batch, "value"):
            asked: set[tuple[int, str]] = set()
            for _ in NestedIndex(texts).nodes(lambda d, k, asked=asked: asked.add((d, k)) or False):
                pass
            if asked:
                yield pa.RecordBatch.from_arrays([pa.array([places[number[d]] for d, _ in asked]), pa.array([shas[number[d]] for d, _ in asked]), pa.array([k for _, k in asked])], ["place", "text", "key"])


def object_rows_by_text(values: DataFrame, keys: DataFrame) -> DataFrame:
    """As ``object_rows`` with any number of ``keys`` (place, key): each text gets those of its own keys by joins."""
    named = values.withColumn("text", F.sha2("value", 256))
    own = named.select("place", "text", "value").mapInArrow(_lone_keys, "place string, text string, key string").distinct()
    per_text = own.join(keys, ["place", "key"], "left_semi").groupBy("place", "text").agg(F.collect_list("key").alias("keys"))  # no more than a text holds

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ids, lists = (batch.column(c).to_pylist() for c in ("place", "id", "keys"))
            for number, texts in _blocks(batch, "value"):
                own = [frozenset(lists[i] or ()) for i in number]
                out = [(number[d], p, n) for d, p, n in NestedIndex(texts).nodes(lambda d, k, own=own: k in own[d])]
                if out:
                    yield _emit(places, ids, out)

    return named.join(per_text, ["place", "text"], "left").select("place", "id", "value", "keys").mapInArrow(rows, _ROWS)


#: Most distinct array keys that are sent to the tasks; with more of them (keys made from data) they are joined instead.
MAX_ARRAY_KEYS = 100_000


def flatten_objects(columns: list[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """(table_name, column_name, record_id, parent_path, node_path) over JSON columns.

    ``columns``: (table name, column name, table, id column). The keys that hold arrays of objects anywhere in a column
    are found in a first pass. They are schema as a rule and sent to the tasks; beyond ``MAX_ARRAY_KEYS`` they are joined.
    """
    parts = [
        df.select(F.lit(f"{t}\t{c}").alias("place"), F.col(key).cast("bigint").alias("id"), F.col(c).cast("string").alias("value"))
        for t, c, df, key in columns
    ]
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    values = values.where(F.col("value").rlike(r"[\[{]|\\u00[57][bB]"))
    found = object_array_keys(values).take(MAX_ARRAY_KEYS + 1)
    if len(found) > MAX_ARRAY_KEYS:
        rows = object_rows_by_text(values, object_array_keys(values))
    else:
        keys: dict[str, set[str]] = {}
        for place, key in found:
            keys.setdefault(place, set()).add(key)
        rows = object_rows(values, {p: frozenset(k) for p, k in keys.items()})
    split = F.split("place", "\t")
    return rows.select(split[0].alias("table_name"), split[1].alias("column_name"), "record_id", "parent_path", "node_path")
