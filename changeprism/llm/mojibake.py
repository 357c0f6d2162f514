"""Texts decoded with a wrong character encoding: detection and round-trip repair.

A run of characters outside ASCII is re-encoded under each legacy encoding that may have been used wrongly and strictly
decoded as the encoding it should have been read with. One garbling cost decides: of the run and of every candidate it
counts what correct writing lacks - symbols and marks inside words, capitals after small letters, letters of different
scripts side by side, control characters, letters that no language uses much, and for Cyrillic how unlikely its letters
are as Russian. The cheapest candidate is taken if it is cheaper than the run by ``MARGIN`` at least; one that is cheaper
by less is taken only in a text that is surely garbled elsewhere. Escapes (HTML entities, \\uXXXX) are read first, and
layers are undone one after another as long as the cost drops. U+FFFD is garbling beyond repair.

Defined results: null, empty and blank texts are not garbled; repeated rows repeat. A text that cannot be restored as
a whole keeps its unrepaired runs and gets restored = false.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 is wrongly read with: name and the codec's alphabets.
SINGLE_BYTE = ("latin-1", "cp1252", "cp1250", "iso8859-2", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8-r", "iso8859-15", "cp1254", "cp1257")
DOUBLE_BYTE = ("gbk", "cp932", "big5", "cp949")
#: (read as, should be) of single-byte Cyrillic and Latin encodings taken for each other.
CYRILLIC_SWAPS = (("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_cyrillic", "cp1251"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"))
#: How much cheaper a repair is at least, in nats of surprise.
MARGIN, COINCIDENCE = 3.0, 0.5

#: Relative frequencies of the Russian letters а to я with ё last, in percent (fixed values).
RUSSIAN = (
    8.01, 1.59, 4.54, 1.70, 2.98, 8.45, 0.94, 1.65, 7.35, 1.21, 3.49, 4.40, 3.21, 6.70, 10.97, 2.81,
    4.73, 5.47, 6.26, 2.62, 0.26, 0.97, 0.48, 1.44, 0.73, 0.36, 0.04, 1.90, 1.74, 0.32, 0.64, 2.01, 0.04,
)
_RU_COST = {c: -math.log(p / 100) for c, p in zip("абвгдежзийклмнопрстуфхцчшщъыьэюяё", RUSSIAN, strict=True)}

_POLISH = "ĄĆĘŁŃŚŹŻąćęłńśźż"
#: What a repair may give.
_EXPECTED = re.compile(
    "[\x00-\x7f -ſƒˆ˜Ά-ώЁЄІЇА-яёєіїҐґḀ-ỿ"
    " -⁯₠-₿℀-⅏←-⋿⌀-⏿①-⓿─-➿　-ヿ一-鿿가-힣"
    "ﬁﬂ️﻿！-～｡-ﾟ̀-ͯ\U0001f000-\U0001faff⬀-⯿]+"
)
_RUN = re.compile("[A-Za-z]?[^\x00-\x7f]+[A-Za-z]?")
_ESCAPE = re.compile(r"&(?:#\d{2,6}|#[xX][0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d{0,2});|\\u[0-9a-fA-F]{4}")
_ESCAPED = re.compile(rf"(?:(?:{_ESCAPE.pattern})[^\x00-\x7f]?){{2,}}|(?:{_ESCAPE.pattern})")
_CLOSING = "…»”“’—–"


def _bytes(s: str, encoding: str) -> bytes | None:
    try:
        return s.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1250", "cp1251", "cp1254"):
            return None
    out = bytearray()  # undefined bytes of these encodings are often passed through as control characters
    for c in s:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) < 0xA0:
                return None
            out.append(ord(c))
    return bytes(out)


def _utf8(data: bytes | None) -> str | None:
    if data is None:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _cjk(s: str) -> bool:
    return all("　" <= c <= "ヿ" or "一" <= c <= "鿿" or "！" <= c <= "ﾟ" or "가" <= c <= "힣" or c in "“”‘’…—·" or c < "\x80" for c in s)


def _cyrillic_cost(word: str) -> float:
    """Mean surprise of a word's letters as Russian, more for capitals inside or after small letters."""
    low = word.lower()
    cost = sum(_RU_COST.get(c, 8.0) for c in low) / len(low)
    odd = sum(b.isupper() and a.islower() for a, b in zip(word, word[1:], strict=False))
    return cost + 2.0 * odd / len(word)


#: Letters outside ASCII that the texts' languages use in running words, marks of running text, symbols of Latin-1.
_USUAL = set("àâäáãåæçèéêëíìîïñóòôöõøœúùûüßąćęłńśźż" "абвгдежзийклмнопрстуфхцчшщъыьэюяё")
_MARKS = set("—–…“”‘’„«»→✓≈€•")
_SYMBOLS = set("\xa0¡¢£¤¥¦§¨©ª«¬\xad®¯°±²³´µ¶·¸¹º»¼½¾¿×÷")


def _script(c: str) -> int:
    k = ord(c)
    return 1 if k < 0x250 or 0x1E00 <= k < 0x1F00 else 2 if 0x370 <= k < 0x400 else 3 if 0x400 <= k < 0x530 else 4 if 0x2E80 <= k < 0xFB00 or k > 0xFFFF else 5


@lru_cache(maxsize=10_000)
def _own_cost(c: str) -> float:
    """What a character costs wherever it stands."""
    if c < "\x80":
        return 1.0
    if c < "\xa0" or c == "�" or unicodedata.combining(c):
        return 6.0
    low = c.lower()
    if low in _USUAL:
        return min(_RU_COST[low], 5.0) if low in _RU_COST else 3.0 if c != low else 2.0
    if c in _MARKS:
        return 2.0
    if c in _SYMBOLS:
        return 3.0
    if _cjk(c):
        return 3.5
    if c.isalpha():
        return 8.0 if _script(c) == 3 else 6.0 if c != low else 5.0
    return 3.0


@lru_cache(maxsize=200_000)
def cost(run: str, before: str, after: str) -> float:
    """The garbling cost of a run; ``before`` and ``after``: the ASCII letter right before and after (a or A), or ''."""
    out, last = 0.0, len(run) - 1
    for i, c in enumerate(run):
        left = run[i - 1] if i else before or " "
        right = run[i + 1] if i < last else after or " "
        out += _own_cost(c)
        if c.isalpha():
            if left.isalpha():
                out += 5.0 * (_script(left) != _script(c))
                out += 4.0 * (c.isupper() and left.islower())
                out += 2.0 * (left > "\x7f" and _script(c) == 1)  # of two letters in a row one is plain as a rule
        elif c in _MARKS:
            out += 5.0 * (c != "’" and left.isalpha() and right.isalpha())
        elif c > "\x7f":
            out += 4.0 * (left.isalpha() or right.isalpha() and c not in "¿¡")
    return out


@lru_cache(maxsize=200_000)
def least_cost(run: str, before: str, after: str) -> float:
    """The cost of a run or of what it may have been, layer under layer, whichever is least."""
    return min([cost(run, before, after), *(least_cost(f, before, after) for f in candidates(run) if len(f) < len(run))])


def candidates(run: str) -> Iterator[str]:
    """What a run may have been: strict decodings as UTF-8 or another encoding that are shorter or Russian."""
    if len(run) < 2:
        return
    for encoding in SINGLE_BYTE:
        fixed = _utf8(_bytes(run, encoding))
        if fixed is not None and len(fixed) < len(run) and (_EXPECTED.fullmatch(fixed) or all("\x80" <= c <= "\xff" for c in fixed)):
            yield fixed
    if len(run) >= 3:
        for encoding in DOUBLE_BYTE:
            fixed = _utf8(_bytes(run, encoding))
            if fixed and len(fixed) < len(run) and _cjk(fixed) and sum(c > "\x7f" for c in fixed) >= 2:
                yield fixed
        if all(c.isalpha() or c in "÷×" for c in run):
            for read, meant in CYRILLIC_SWAPS:
                data = _bytes(run, read)
                try:
                    fixed = data.decode(meant) if data else None
                except UnicodeDecodeError:
                    continue
                # a word of Russian letters, small after the first, and not of two letters only
                if fixed and all(c.lower() in _RU_COST for c in fixed) and fixed[1:].islower() and len(set(fixed)) >= 3 and _cyrillic_cost(fixed) < 3.4:
                    yield fixed


@lru_cache(maxsize=200_000)
def undo(run: str, before: str, after: str) -> tuple[str | None, bool]:
    """(``run`` with one layer of wrong decoding undone or None, whether the cost drops by ``MARGIN``, here or layers below)."""
    own = cost(run, before, after)
    best, drop = None, 0.0
    for fixed in candidates(run):  # that bytes make up whole characters by chance is unlikely, the more of them the less likely
        d = own - least_cost(fixed, before, after) + COINCIDENCE * (len(run) - len(fixed))
        if d > drop:
            best, drop = fixed, d
    return best, drop >= MARGIN


def _letter(c: str) -> str:
    """The class of a neighbour: a small or a capital letter, or none."""
    return "" if not c.isalpha() else "A" if c.isupper() else "a"


_PIECES: dict[str, re.Pattern] = {}


def _piece(encoding: str) -> re.Pattern:
    """Characters that stand for one UTF-8 sequence read as a single-byte encoding."""
    if encoding not in _PIECES:
        table = bytes(range(0x80, 0x100)).decode(encoding, "replace")
        cls = lambda a, z: "[" + re.escape("".join(c for c in table[a - 0x80 : z - 0x7F] if c != "�")) + ("\x80-\x9f" if encoding != "latin-1" else "") * (a == 0x80) + "]"
        tail = cls(0x80, 0xBF)
        _PIECES[encoding] = re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+")
    return _PIECES[encoding]


def _inside(run: str, before: str, after: str, trust: bool = False) -> tuple[str | None, bool]:
    """As ``undo``, for garbled characters beside correct ones in one run; with ``trust`` pieces with any drop are taken."""
    for encoding in ("latin-1", "cp1252", "cp1250", "cp437", "cp850", "mac_roman"):
        sure = False

        def sub(m: re.Match) -> str:
            nonlocal sure
            if m[0][0] not in "ÂÃÄÅÐÑâãäåæçèéðĂĹĄ├┬┼─ÔÕ√¬Γ" and encoding != "latin-1":
                return m[0]
            fixed, ok = undo(m[0], _letter(m.string[m.start() - 1]) if m.start() else before, _letter(m.string[m.end()]) if m.end() < len(m.string) else after)
            sure |= ok or trust and fixed is not None
            return fixed if ok or trust and fixed is not None else m[0]

        fixed = _piece(encoding).sub(sub, run)
        if sure:
            return fixed, True
    return None, False


_CYRILLIC_WORD = re.compile("[А-яЁё]+")


def _capital(word: str) -> bool:
    return 2 * sum(map(str.isupper, word)) >= len(word)


def _swapped_line(line: str) -> str | None:
    """``line`` with its mostly capital Cyrillic words put right if they are likelier Russian in another encoding."""
    words = [w for w in _CYRILLIC_WORD.findall(line) if len(w) > 1 and _capital(w)]
    letters = sum(map(len, words))
    if letters < 10:
        return None
    own = sum(_cyrillic_cost(w) * len(w) for w in words) / letters
    for read, meant in (("cp1251", "koi8-r"), ("koi8-r", "cp1251")):
        try:
            fixed = [w.encode(read).decode(meant) for w in words]
        except UnicodeError:
            continue
        if all(c.lower() in _RU_COST for w in fixed for c in w) and own - sum(_cyrillic_cost(w) * len(w) for w in fixed) / letters > 0.35:
            return _CYRILLIC_WORD.sub(lambda m: m[0].encode(read, "replace").decode(meant) if _capital(m[0]) else m[0], line)
    return None


_CAPITALS = re.compile("[А-Я]{3}")


def _swapped_lines(text: str) -> tuple[str, bool]:
    """(text with such lines put right, whether there was one)."""
    if not _CAPITALS.search(text):
        return text, False
    lines = text.split("\n")
    fixed = [_swapped_line(x) if _CAPITALS.search(x) else None for x in lines]
    return "\n".join(x if f is None else f for x, f in zip(lines, fixed, strict=True)), any(f is not None for f in fixed)


def _layer(text: str) -> tuple[str, bool, bool]:
    """(text with one layer undone, whether any run was surely garbled, whether any was not restored)."""
    found, lost, weak = False, False, False

    def sub(m: re.Match, trust: bool = False) -> str:
        nonlocal found, lost, weak
        s = m[0]
        a, z = s[0] < "\x80", len(s) - (s[-1] < "\x80")
        run, before, after = s[a:z], _letter(s[0]) if a else "", _letter(s[-1]) if z < len(s) else ""
        if "�" in run:
            found = lost = True
            return s
        fixed, sure = undo(run, before, after)
        broken = trust or any("\x80" <= c < "\xa0" for c in run)  # a control character is never right
        if not sure and (inner := _inside(run, before, after, broken))[1]:
            fixed, sure = inner
        found |= sure
        if fixed is None or not (sure or trust):
            weak |= fixed is not None
            return s
        return s[:a] + fixed + s[z:]

    base, swapped = _swapped_lines(text)
    out = _RUN.sub(sub, base)
    if found and weak:
        out = _RUN.sub(lambda m: sub(m, True), base)
    return out, found or swapped, lost


def _read_escapes(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m[0]
        c = chr(int(e[2:], 16)) if e[0] == "\\" else html.unescape(e)
        if e[0] == "&" and e[1] == "#":
            n = int(e[3:-1], 16) if e[2] in "xX" else int(e[2:-1])
            c = chr(n) if 0x80 <= n < 0x110000 and not 0xD800 <= n < 0xE000 else c
        return c if len(c) == 1 and c > "\x7f" and not "\ud800" <= c <= "\udfff" else e

    return _ESCAPE.sub(one, text)


def repair(text: str | None) -> tuple[bool, str | None, bool]:
    """(garbled, text as far as it was restored, restored as a whole)."""
    if not text:
        return False, text, True
    garbled = False
    out, found, lost = _layer(text)
    if _ESCAPE.search(text):
        read = _ESCAPED.sub(lambda m: _read_escapes(m[0]), text)
        if read != text:
            own, hidden, gone = _layer(read)
            if hidden and not found:
                out, found, lost = own, True, gone or lost
            elif hidden and own != out:
                out = own
    while found:  # every layer but one beyond repair makes the text shorter or cheaper
        garbled = True
        again, found, more = _layer(out)
        lost |= more
        if again == out:
            break
        out = again
    return garbled, out, not lost


#: Texts without these are not looked at.
_MAY_BE = "[^\\x00-\\x7f]|&#?\\w{2,8};|\\\\u[0-9a-fA-F]{4}"


def garbled_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, restored): the garbled texts of ``documents`` as far as they could be restored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *repair(t)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())],
                [key, "text", "restored"],
            )

    may = documents.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(_MAY_BE))
    return may.mapInArrow(run, f"{key} bigint, text string, restored boolean")
