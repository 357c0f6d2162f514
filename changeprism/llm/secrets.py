"""Credentials in patches and messages: where they begin, and the texts with only the secret values redacted.

Each side of a hunk (its context with the added lines, its context with the removed ones) and each message is tokenized
lexically into words, operators, brackets and string literals of any kind (escapes, triple quotes, raw and escaped
quotes), over line ends; strings are tokenized again inside. From each credential-named identifier or key the parser
goes on over a type annotation, an operator or an opening bracket, wrappers and line ends to the literal that is assigned
or passed; it is a secret, with the literals joined to it, unless it is a placeholder or a reference. Markup, flags,
prose, literals in the formats of well-known issuers, passwords in URLs and headers, and private key blocks have
patterns of their own. Only the literal's content is redacted: delimiters, escapes and the rest of the line stay.

One automaton over the words of all detectors finds the lines to look at; a side is tokenized only where it holds such.

Defined results: null and empty texts hold nothing; broken JSON holds nothing; a file without filename has place ''.
Several credentials that begin in one line are one row; a literal that goes on in the next line begins in its first that
is not blank. Repeated rows repeat.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "[REDACTED]"

#: Last words of credential-named identifiers, without separators (fixed values).
_NAMES = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "bearer", "secretkey", "accesskey", "privatekey", "signingkey", "encryptionkey", "authkey", "masterkey", "sharedkey", "credential", "credentials", "clientkey", "storagekey", "accountkey", "authorization")
_PASS = re.compile(r"(?:^|[_.\-])(?:pass|PASS|Pass|pw|PW)$|[a-z]Pass$")
#: Formats of issuers' keys.
_ISSUED = (
    r"sk_(?:live|test)_[A-Za-z0-9]{16,}|rk_live_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w\-]{16,}"
    r"|AIza[\w\-]{30,}|(?:AKIA|ASIA)[A-Z0-9]{16}\b|xox[abprs]-[A-Za-z0-9\-]{10,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|npm_[A-Za-z0-9]{30,}"
    r"|eyJ[\w\-]{10,}\.eyJ[\w\-]{10,}\.[\w\-]{10,}|pypi-[\w\-]{30,}|hf_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9\-]{32,}|dop_v1_[0-9a-f]{40,}"
)
_ISSUED_RE = re.compile(rf"(?<![A-Za-z0-9_])(?:{_ISSUED})")
_PLACEHOLDER = re.compile(
    r"""(?ix) ^ (?: \W* | x{3,} | (?:[*.x\-_•#0]){3,} | <.*> | \[.*\] | \{\{.*\}\} | \$\{.*\} | \$\(.*\) | \$\w+ | %\(?\w*\)?[sd]? | %\w+% | @\w+@ | \#\{.*\}
      | redacted | removed | hidden | masked | todo | tbd | fixme | none | null | nil | undefined | true | false | string | str | bytes | int | bool | empty | changeme | change_me | change-me
      | (?:your|my|the|some|insert|enter|replace|dummy|sample|example|fake|placeholder)[\s_\-].* | .*(?:_|-)here | placeholder | dummy | sample | example | test | secret | password | passwd | token | pass | pwd | apikey | api_key
      | (?:vault|env|secret|secrets|ssm|op|file|keyring|keychain|config|var|data|local|arn|aws|gcp|az|ref|kms)[:.].* | ENC\(.*\) | !\w+.* | vault\b.* | secretref.* | process\.env\b.* | os\.(?:environ|getenv)\b.* | System\.getenv.* ) $ """
)
_REFERENCE = re.compile(r"(?i)\$\{|\{\{|\$\(|%\(\w+\)s|^\$\w|process\.env|os\.environ|getenv|secretKeyRef|valueFrom|/run/secrets|vault")
_QUOTED = r"""(?P<q>\"{1,3}|\\"|'{1,3}|`)(?P<s>(?:\\.|(?!(?P=q)).)*)"""
_BARE_VALUE = r"[^\s\"'`,;()<>\[\]{}]+|\$\{.*?\}|\{\{.*?\}\}|<[^>]*>|\$\(.*?\)"
_BARE = re.compile(_BARE_VALUE)
_VALUE = rf"(?:\(\s*)?[bBfFrRuU]?(?:{_QUOTED}|(?P<b>{_BARE_VALUE}))"
_ENV = re.compile(r"^\s*(?:ENV|ARG|set|setenv|SET)\s+(?P<n>[A-Za-z_][\w.\-]*)\s+(?P<b>\S.*?)\s*$")
_FLAG = re.compile(rf"(?:^|\s)--?(?P<n>[A-Za-z][\w.\-]*)[ \t]+{_VALUE}")
_XML = re.compile(r"<(?P<n>[A-Za-z_][\w.\-]*)(?:\s[^<>]*)?>(?P<b>[^<>]*)</")
_XML_PAIR = re.compile(r"""(?:name|key|id)=\\?["'](?P<n>[\w.\-]+)\\?["'][^<>]*?\bvalue=(?P<q>\\?["'])(?P<s>.*?)(?P=q)""")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@\"'`<>]*:(?P<b>[^\s@/\"'`<>]+)@")
_HEADER = re.compile(r"""(?i)\b(?:proxy-)?authorization["'`]?\s*[:=,]\s*["'`]?\s*(?:basic|bearer|token|apikey|digest)\s+(?P<b>[^\s"'`,;]+)""")
_SCHEME = re.compile(r"""(?:\b(?:Bearer|Basic)\s+|\bbearer[\s:]+[`"']?)(?P<b>[A-Za-z0-9][\w+/=.\-~!]{7,})""")
_USER = re.compile(r"""\s(?:-u|--user)[ =]\s*["']?[^\s:"'/]+:(?P<b>[^\s"'@]+)""")
_LOGIN = re.compile(r"""\blogin\b[^\n]*?\s(?:-p|--password)[ =]\s*["']?(?P<b>[^\s"']+)""")
_ACCOUNT = (
    re.compile(r"(?i)\bidentified\s+(?:with\s+\w+\s+)?by\s+(?:password\s+)?['\"](?P<b>[^'\"]+)"),
    re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b[^|\n]*?\s-p(?P<b>[^\s'\"]+)"),
    re.compile(r"\bsshpass\s+-p\s*['\"]?(?P<b>[^\s'\"]+)"),
    re.compile(r"""(?i)\bconnect\w*\(\s*(?:["'][^"']*["']\s*,\s*){2}["'](?P<b>[^"']+)["']"""),
    re.compile(r"""(?i)\b(?:key|pass|password|passwd|pwd|secret|token|bearer|passphrase|credential)\s+`(?P<b>[^`\n]+)`"""),
)
_PROSE = (
    re.compile(r"""(?i)\b(?:password|passwd|passphrase|pwd|pw|secret|passcode)\b(?:\s+(?:for|of|to|on)\b[^:=\n]*?)?\s*(?:\bis\b|\bwas\b|:|=|->)\s*[`"']?(?P<b>[^\s`"']+)"""),
    re.compile(r"""(?i)\b(?:password|passwd|pwd|pw|token|secret|bearer)\s+[`"']?(?P<b>[^\s`"',]{8,})"""),
    re.compile(r"""(?i)\b(?:key|token|credential|creds?)\s*(?:->|:|=|\bis\b)\s*[`"']?(?P<b>[^\s`"',]{8,})"""),
    re.compile(r"""(?i)\blog[\s-]?in\s+[\w.@-]+\s*/\s*(?P<b>\S{6,})"""),
)
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Of a key without END: what is left of the first line, headers, and lines of base64; one shorter line may be the last.
_KEY_REST = re.compile(r"(?:\\[nrt]|[A-Za-z0-9+/= \t])*")
_KEY_HEAD = re.compile(r"\s*(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):.*)?\r?")
_KEY_LINE = re.compile(r"[ \t]*[A-Za-z0-9+/]+={0,2}[ \t]*\r?")
#: Words without one of which, in any case, a line holds no credential; the JVM's pattern is made of them too.
HINTS = (
    "pass", "pwd", "pw", "secret", "token", "api", "bearer", "key", "cred", "auth", "login", "log in", "log-in", "://", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat", "glpat-", "aiza", "xox", "sg.", "npm_", "eyj",
    "sk_", "rk_", "pypi-", "hf_", "sk-", "dop_v1", "-u ", "-u=", "--user", "basic ", "identified", "mysql", "mariadb", "connect",
)
HINT = "(?i)" + "|".join(h.replace(".", "\\.") for h in HINTS)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for h in HINTS:
        a.add_word(h, len(h))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


@lru_cache(50_000)
def credential_name(name: str) -> bool:
    bare = name.replace("_", "").replace("-", "").replace(".", "").lower()
    return bare.endswith(_NAMES) or _PASS.search(name) is not None


def _secretlike(value: str, least: int = 6) -> bool:
    """Whether a bare word may be a secret rather than an identifier or prose."""
    if len(value) < least or "(" in value or "[" in value:
        return False
    digit = any(c.isdigit() for c in value)
    letter = any(c.isalpha() for c in value)
    mixed = any(c.islower() for c in value) and any(c.isupper() for c in value[1:])
    return letter and (digit or (mixed and len(value) >= 10 and not re.fullmatch(r"[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)+", value)))


def _placeholder(value: str) -> bool:
    return _PLACEHOLDER.match(value) is not None or _REFERENCE.search(value) is not None


def _line_spans(line: str) -> list[tuple[int, int]]:
    """Spans of secret values in one line that are told by their own form or by markup, flags, headers and prose."""
    spans: list[tuple[int, int]] = []

    def take(m: re.Match, group: str, bare: bool, least: int = 6) -> None:
        a, z = m.span(group)
        value = m[group]
        if bare:
            value = value.rstrip(".,;)\\")
            z = a + len(value)
        if _placeholder(value) or len(value) < 4 or (bare and not _secretlike(value, least)):
            return
        spans.append((a, z))

    spans += [m.span() for m in _ISSUED_RE.finditer(line) if not re.search(r"(?i)example|x{6}|0{8}|1234567890", m[0])]
    if "://" in line:
        for m in _URL.finditer(line):
            if not _placeholder(m["b"]) and len(m["b"]) > 3:
                spans.append(m.span("b"))
    for m in _HEADER.finditer(line):
        take(m, "b", True)
    for m in _SCHEME.finditer(line):
        take(m, "b", True, 8)
    for pattern in (_USER, _LOGIN, *_ACCOUNT):
        for m in pattern.finditer(line):
            take(m, "b", False)
    for pattern in (_ENV, _FLAG, *((_XML, _XML_PAIR) if "<" in line or "=" in line else ())):
        at = 0
        while m := pattern.search(line, at):
            at = m.end("n")
            if not credential_name(m["n"]) or pattern is _FLAG and (m["b"] or "")[:1] == "-":
                continue
            group = "s" if m.groupdict().get("s") is not None else "b"
            take(m, group, group == "b")
    for i, pattern in enumerate(_PROSE):
        for m in pattern.finditer(line):
            if _secretlike(m["b"].rstrip(".,;"), 8 if i == 2 else 6):
                take(m, "b", True)
    return spans


_PREFIX = r"(?:(?<![A-Za-z0-9_])[bBfFrRuU]{1,2})?"
#: Tokens. Strings: of three quotes over lines, between escaped quotes, of one quote, and open to the end of a line.
_TOKEN = re.compile(
    rf"""(?P<nl>\n)|(?P<ws>[ \t\r]+|/\*[^\n]*?\*/)
    |{_PREFIX}(?P<q>\"{{3}}|'{{3}})(?P<s3>(?:\\[\s\S]|(?!(?P=q))[^\\])*)(?P=q)
    |\\"(?P<se>(?:(?!\\").)*)\\"
    |{_PREFIX}"(?P<s1>(?:[^"\\\n]|\\.)*)"
    |(?<![A-Za-z0-9_']){_PREFIX}'(?P<s2>(?:[^'\\\n]|\\.)*)'
    |`(?P<sb>[^`\n]*)`
    |(?:\\?"|(?<![A-Za-z0-9_])'|`)(?P<so>[^\n"'`]+)(?=\n|\Z)
    |(?P<w>[A-Za-z_$@][\w.\-$]*)
    |(?P<op>:=|=>|\?=|->|<-|==|!=|<=|>=|=~|::|[=:])
    |(?P<o>[^\n])""",
    re.X,
)
_STRINGS = ("s3", "se", "s1", "s2", "sb", "so")
_ASSIGNS = frozenset((":=", "=>", "?=", "->", "<-", "=", ":"))
_KEY_WORD = re.compile(r"[A-Za-z_][\w.\-]*")
#: What a literal may be wrapped in on its way to a name (fixed values).
WRAPPERS = frozenset(
    ("new", "SecretStr", "SecretBytes", "Secret", "String", "str", "bytes", "bytearray", "Some", "Ok", "Just", "Buffer.from", "atob", "b64decode", "base64.b64decode", "Base64.decode", "base64.StdEncoding.DecodeString", "Optional.of", "of", "Value", "Field", "to_string", "unhexlify", "bytes.fromhex")
)


class _Lexer:
    """Tokens of one text and the literals that its credential names get."""

    def __init__(self, text: str, base: int = 0):
        self.text = text
        self.kind: list[str] = []
        self.start: list[int] = []
        self.value: list[str] = []
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind in ("ws",):
                continue
            if kind == "q":  # the pattern of three quotes names its content last
                kind = "s3"
            self.kind.append(kind)
            self.start.append(m.start(kind))
            self.value.append(m[kind])
        self.base, self.found = base, []

    def literals(self) -> list[list[tuple[int, int]]]:
        """Of each secret literal the spans of its parts."""
        kind, value = self.kind, self.value
        taken: set[int] = set()
        for i, k in enumerate(kind):
            if k == "w":
                name = value[i].strip("$@").rstrip("-.")
                if credential_name(name[-60:]):
                    self._after(i, name, taken)
                elif name[:4].lower() == "auth":
                    self._pair(i, taken)
            elif k in _STRINGS and len(value[i]) > 1 and _KEY_WORD.fullmatch(value[i]) and credential_name(value[i][-60:]):  # the end of a name decides
                self._after(i, value[i], taken)
        for i, k in enumerate(kind):
            if k in _STRINGS and i not in taken and len(value[i]) > 8 and _INSIDE.search(value[i]):
                self.found += _Lexer(value[i], self.base + self.start[i]).literals()
        return self.found

    def _after(self, i: int, name: str, taken: set[int]) -> None:
        kind, value, n = self.kind, self.value, len(self.kind)
        j, closed = i + 1, 0
        while j < n and closed < 2 and kind[j] == "o" and value[j] in "])'\"`\\":
            j, closed = j + 1, closed + 1
        if j >= n:
            return
        quoted = kind[i] != "w"
        bare = True
        if kind[j] == "op" and value[j] in _ASSIGNS:
            at = self._annotated(j + 1) if value[j] == ":" else None
            j = at if at is not None else j + 1
        elif value[j] == "(" and not quoted and j == i + 1 or value[j] == "," and kind[j] == "o" and quoted and not (i and kind[i - 1] == "op"):
            j, bare = j + 1, False
        else:
            return
        depth = 0 if bare else 1
        first = j
        while j < n:
            if kind[j] == "nl" and (depth or value[j - 1] == "\\"):
                j += 1
            elif kind[j] == "o" and (value[j] in "([" or value[j] == "\\" and j + 1 < n and kind[j + 1] == "nl"):
                depth, j = depth + (value[j] != "\\"), j + 1
            elif kind[j] == "w" and value[j] in WRAPPERS and j + 1 < n and (value[j + 1] == "(" or value[j] == "new"):
                j += 1
            else:
                break
        if j >= n:
            return
        if kind[j] in _STRINGS:
            if not (name.lower().endswith("authorization") and " " in value[j]):
                self._take(j, depth, taken)
        elif bare and kind[j] != "nl" and (j == first or kind[j] in ("w", "o", "op")):
            m = _BARE.match(self.text, self.start[j])
            if m:
                word = m[0].rstrip(".,;)\\")
                if len(word) >= 4 and not _placeholder(word) and _secretlike(word):
                    self.found.append([(self.base + m.start(), self.base + m.start() + len(word))])

    def _annotated(self, j: int) -> int | None:
        """Where the value begins after a type annotation at ``j`` and an equals sign; None if there is no such."""
        kind, value, n, depth, start = self.kind, self.value, len(self.kind), 0, j
        while j < n:
            k, v = kind[j], value[j]
            if k == "op":
                if v == "=" and not depth:  # at the end of a line it is padding of what stands before
                    return j + 1 if j > start and j + 1 < n and kind[j + 1] != "nl" else None
                if not depth and v not in ("::", "->"):
                    return None
            elif k == "o" and v in "[(<":
                depth += 1
            elif k == "o" and v in "])>":
                depth -= 1
                if depth < 0:
                    return None
            elif not depth and (k == "nl" or k in _STRINGS or k == "o" and v not in "|?.*&!"):
                return None
            j += 1
        return None

    def _pair(self, i: int, taken: set[int]) -> None:
        """A user name and a password given to auth."""
        kind, value = self.kind, self.value
        j = i + 1
        if j + 4 < len(kind) and kind[j] == "op" and value[j] in ("=", ":") and value[j + 1] in "([" and kind[j + 2] in _STRINGS and value[j + 3] == "," and kind[j + 4] in _STRINGS:
            self._take(j + 4, 0, taken)

    def _take(self, j: int, depth: int, taken: set[int]) -> None:
        """The literal at ``j`` with those joined to it, if it is no placeholder."""
        kind, value, n = self.kind, self.value, len(self.kind)
        parts = [j]
        k = j + 1
        while k < n:
            if kind[k] in _STRINGS and k - 1 in parts and kind[k - 1] in _STRINGS and not depth and not parts[1:]:
                break  # two literals side by side are joined in brackets only
            if kind[k] in _STRINGS:
                parts.append(k)
            elif not (kind[k] == "nl" and (depth or value[k - 1] in "+.\\") or kind[k] == "o" and value[k] in "+.\\"):
                break
            k += 1
        whole = "".join(value[p] for p in parts)
        bare = whole.strip()
        if len(bare) < 4 or _placeholder(bare):
            return
        taken.update(parts)
        spans = []
        for p in parts:
            text = value[p]
            lead = len(text) - len(text.lstrip()) if kind[p] == "s3" else 0
            tail = len(text.rstrip()) if kind[p] == "s3" else len(text)
            if tail > lead:
                spans.append((self.base + self.start[p] + lead, self.base + self.start[p] + tail))
        if spans:
            self.found.append(spans)


#: Strings that are tokenized inside: they hold a name and a sign of assignment.
_INSIDE = re.compile(r"(?i)(?:pass|pwd|pw|secret|token|key|cred|bearer|auth)[\w.\-]*[\\\"'`\])\s]*(?:[=:]|->|<-)")


def _key_end(lines: list[str], starts: list[int], i: int, at: int, patch: bool) -> int:
    """Where a key without END ends that begins in line ``i`` before ``at``."""
    rest = _KEY_REST.match(lines[i], at).end()
    limit, body = starts[i] + rest, False
    if lines[i][rest:].strip():
        return limit
    for k in range(i + 1, len(lines)):
        line = lines[k][1:] if patch and lines[k][:1] in "+- " else lines[k]
        if _KEY_LINE.fullmatch(line) and (body or len(line.strip()) >= 16 or k == len(lines) - 1):
            limit, body = starts[k] + len(lines[k]), True
            if len(line.strip()) < 40:
                break
        elif body or not _KEY_HEAD.fullmatch(line):
            break
    return limit


def _hinted_lines(text: str, starts: list[int]) -> set[int]:
    """Lines that hold a word of a detector."""
    low = text.lower()
    if len(low) != len(text):  # a letter that is longer in lower case
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    return {bisect_right(starts, end) - 1 for end, _ in _AUTOMATON.iter(low)}


def _sides(lines: list[str], starts: list[int], patch: bool, hinted: set[int], skip: set[int]) -> Iterator[tuple[str, list[int], list[int], bool]]:
    """(text, offset of each of its lines in it, offset in the whole text, whether it is a side without removed lines) of the
    parts to tokenize: a message as a whole, both sides of each hunk with a hinted line."""

    def part(numbers: list[int], off: int) -> tuple[str, list[int], list[int]]:
        own, places, at = [], [], 0
        for i in numbers:
            own.append(lines[i][off:])
            places.append(at)
            at += len(lines[i]) - min(off, len(lines[i])) + 1
        return "\n".join(own), places, [starts[i] + min(off, len(lines[i])) for i in numbers]

    if not patch:
        numbers = [i for i in range(len(lines)) if i not in skip]
        yield *part(numbers, 0), True
        return
    heads = [i for i, line in enumerate(lines) if line[:2] == "@@"]
    for a, z in zip([0, *heads], [*heads, len(lines)], strict=True):
        numbers = [i for i in range(a, z) if i not in skip]
        if not any(i in hinted for i in numbers):
            continue
        if numbers and numbers[0] in heads:
            if numbers[0] in hinted:
                yield *part(numbers[:1], 0), True
            numbers = numbers[1:]
        new = [i for i in numbers if lines[i][:1] != "-"]
        if any(i in hinted for i in new):
            yield *part(new, 1), True
        if any(i in hinted and lines[i][:1] == "-" for i in numbers):
            yield *part([i for i in numbers if lines[i][:1] != "+"], 1), False


def spans(text: str | None, patch: bool = False) -> list[tuple[int, int, int]]:
    """(line number from 1, start, end) of the secret values in ``text``, by the line in which each begins."""
    if not text:
        return []
    lines = text.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    hinted = _hinted_lines(text, starts)
    if not hinted:
        return []
    out: list[tuple[int, int, int]] = []
    skip: set[int] = set()
    if "PRIVATE KEY" in text:
        skip_to = 0
        for i, line in enumerate(lines):
            if i < skip_to or "PRIVATE KEY" not in line or not (m := _BEGIN.search(line)):
                continue
            k, a = i, starts[i] + m.end()
            end = _END.search(text, a)
            if end and _BEGIN.search(text, a, end.start()):
                end = None  # the end of another key
            limit = end.start() if end else _key_end(lines, starts, i, m.end(), patch)
            if (last := text.rfind("\n", a, limit)) >= 0 and end:
                limit = last
            out.append((i + 1, a, limit))
            while k + 1 < len(lines) and starts[k + 1] <= limit:
                k += 1
            skip_to = k + 1
            skip.update(range(i, skip_to))
    for i in hinted - skip:
        line = lines[i]
        off = 1 if patch and line[:1] in "+- " else 0
        out += [(i + 1, starts[i] + off + a, starts[i] + off + z) for a, z in _line_spans(line[off:])]
    for side, places, origin, whole in _sides(lines, starts, patch, hinted, skip):
        for parts in _Lexer(side).literals():
            begin = bisect_right(places, parts[0][0]) - 1
            number = bisect_right(starts, origin[begin]) - 1
            if not whole and lines[number][:1] != "-":
                continue  # found on the other side
            for a, z in parts:
                k = bisect_right(places, a) - 1
                while a < z:  # line by line
                    end = min(z, places[k + 1] - 1 if k + 1 < len(places) else z)
                    if end > a:
                        out.append((number + 1, origin[k] + a - places[k], origin[k] + end - places[k]))
                    k += 1
                    a = places[k] if k < len(places) else z
    return sorted(set(out))


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """``text`` with the spans replaced; line feeds and diff marks inside a span stay."""
    out, at = [], 0
    for _, a, z in sorted(found, key=lambda s: s[1:]):
        if a < at:
            a = at
        if z <= a:
            continue
        inner = text[a:z]
        out += [text[at:a], re.sub(r"(?m)(?<=\n)([+\- ]?)[^\n]+", r"\1" + MASK, "\n" + inner)[1:] if "\n" in inner else MASK]
        at = z
    return "".join([*out, text[at:]])


def files_of(value) -> Iterator[tuple[str, str]]:
    """(filename, patch) of every file object of a commit's JSON value, strings of JSON read through."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return
        if isinstance(value, str):
            yield from files_of(value)
            return
    if isinstance(value, dict):
        patch = value.get("patch")
        if isinstance(patch, str):
            name = value.get("filename")
            yield (name if isinstance(name, str) else ""), patch
        for k, x in value.items():
            if isinstance(x, (dict, list)) or (k != "patch" and isinstance(x, str) and x[:1] in ("{", "[")):
                yield from files_of(x)
    elif isinstance(value, list):
        for x in value:
            if isinstance(x, (dict, list)):
                yield from files_of(x)


def _texts(message: str | None, raw: str | None) -> Iterator[tuple[str, str, bool]]:
    if message:
        yield "message", message, False
    if raw:
        try:
            found = list(files_of(raw))
        except RecursionError:
            return
        for name, patch in found:
            yield name, patch, True


def _hinted(commits: DataFrame) -> DataFrame:
    message, raw = F.col("message").cast("string"), F.col("raw_data").cast("string")
    return commits.select(
        F.col("id").cast("bigint").alias("id"),
        F.when(message.rlike(HINT), message).alias("message"),
        # the words of the detectors are sought in the patches; a patch is under that key, however it is escaped
        F.when(raw.contains("patch") | raw.contains("\\u00"), raw).alias("raw_data"),
    ).where("message IS NOT NULL OR raw_data IS NOT NULL")


def credential_lines(commits: DataFrame) -> DataFrame:
    """(record_id, place, line_no) of each line of a commit's message or patches in which a credential begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, message, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                seen = {(place, n) for place, text, patch in _texts(message, raw) for n, _, _ in spans(text, patch)}
                rows += [(i, place, n) for place, n in sorted(seen)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())],
                ["record_id", "place", "line_no"],
            )

    return _hinted(commits).mapInArrow(run, "record_id bigint, place string, line_no int")


def redacted_texts(commits: DataFrame) -> DataFrame:
    """(record_id, place, text): the messages and patches with a credential, only its value replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, message, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for place, text, patch in _texts(message, raw):
                    if found := spans(text, patch):
                        rows.append((i, place, redact(text, found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["record_id", "place", "text"],
            )

    return _hinted(commits).mapInArrow(run, "record_id bigint, place string, text string")
