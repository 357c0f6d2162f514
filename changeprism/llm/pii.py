"""Personal information in free text: occurrences by type, typed placeholders and keyed surrogates.

Spans are found by type in an order in which earlier ones shield later ones (addresses of mail, identity numbers,
phones, street addresses, names). Names are told by given names, or by what stands around them whatever they are: a title,
a trailer of a commit, an address of mail in brackets behind them, a closing formula before them. A surrogate is a keyed bijection of the value's own symbols: digits go to digits,
vowels and consonants of a script to such letters in the same case (letters of other scripts to letters of their block),
given names to given names of the same gender (names of both genders to each other), words of street names to words of
their form, so format, script, accents and gender stay, equal values stay equal everywhere and different values stay
different. Accents ride on their letters and ae, oe, ue stand for umlauts, so a name has one surrogate in all its spellings;
the words of the user part of an address of mail are mapped as names are, so a person stays one person (coreference). The bijection
has no fixed points, and each surrogate is read back: one that does not give its value again is an error, so no two
inputs share an output. Spellings of one given name that are not in the lists themselves count as one value; kinds of
streets, particles, single letters, accents and the few letters without a counterpart (such as the German sharp s) stay.

Defined results: null, empty and blank texts hold nothing; repeated rows repeat; ordinals count per text and type from 1.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMAIL, PHONE, IDENTITY, ADDRESS, NAME = "email", "phone", "identity_number", "street_address", "person_name"

#: Given names by gender (fixed values, a parameter of Finder).
FEMALE = """Agnieszka Aleksandra Alice Amelie Ana Anaïs Andrea Anna Anne Antonia Barbara Beatrice Camille Caroline Catherine Céline Charlotte
Christine Clara Claudia Cordelia Cristina Daniela Deborah Diana Dorothy Elena Eleanor Elisabeth Elizabeth Emily Emma Ewa Fatima Frederike
Gabriela Guadalupe Hannah Heather Helen Helena Isabella Ingrid Jennifer Jessica Johanna Josephine Julia Julie Karen Katarzyna Katharina
Katherine Laura Linda Louise Lucia Magdalena Margaret Margarete María Maria Marie Martha Mary Michelle Monika Natalia Nicole Olga Ottilie
Patricia Paula Penelope Rachel Rebecca Rosa Sandra Sarah Sofía Sophie Stephanie Susan Svetlana Tatiana Teresa Theodora Ursula Valentina
Věra Veronica Wilhelmina Yevgenia Zoë""".split()
MALE = """Alexander Anders André Andrew Anthony Antoine Antonio Augustin Bartholomew Benjamin Björn Brian Carlos Charles Christian
Christopher Claude Daniel David Dennis Diego Dmitri Dominik Donald Edmund Eduardo Edward Emil Enrique Eric Fabian Felipe Fernando
François Frank Franz Gabriel George Gerald Giovanni Gregory Günther Gustav Hans Henri Henry Ignacio Igor Ivan Jakub James Javier Jean
Johannes John Jonathan Jorge José Joseph Józef Juan Jürgen Karl Kenneth Kevin Konstantin Krzysztof Lars Laurent Leonard Louis Luis
Lukas Manuel Marcel Marek Mario Martin Mateusz Matthew Michael Miguel Mikhail Nicholas Nicolas Nikolaus Oliver Olivier Oscar Otto Patrick
Paul Pedro Peter Philip Philippe Pierre Piotr Rafael Raphael Richard Robert Roberto Ronald Samuel Sebastian Sergei Søren Stanisław Stefan
Stephen Steven Thomas Timothy Vincent Vladimir Walter William Wojciech""".split()

#: Of these, names of women and men alike (fixed values); their surrogates are names of this list.
UNISEX = ["Andrea", "Camille", "Claude", "Jean"]

_L = r"(?:[^\W\d_]|\\u[0-9a-fA-F]{4})"
_TOKEN = re.compile(rf"{_L}(?:{_L}|['’](?={_L}))*(?:[-‐]{_L}(?:{_L}|['’](?={_L}))*)*")
_UNESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")

#: Lower-case or capital words that are no family name (fixed values).
_NO_FAMILY = set(
    """a about after again against all also an and any are as asked at author be because been before being both but by call called calls can cannot client
    confirmed contact could customer del der did die do does du el em en et fails fixed for form found from gave got had has have her here hit his how i if in into is it its
    la le les llamó laissé mailed merged my need needs new no not noted of on once only or original our out over pinged please ran record replied reported said saw says see seen sent
    she should so some spoke still team than thanks that the their them then there these they this to too tried und unless until up user usuario von wants was we went were when where
    which while who will with would wrote years you your bitte owner reporter reviewer signed off co authored reviewed acked tested hello dear hi mr mrs ms mx dr prof name phone email
    setting flag theme mode server support unter from cc""".split()
)
_THING_AFTER = re.compile(r"\s+(?:setting|flag|theme|mode|option|plugin|widget|icon|icons|screen|branch|build|channel|server|cluster|feature|module|project|template|preset|profile|palette|font)\b", re.I)

_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|DOT|\.|punkt|punto|point)\s*[\])}]\s*|\s+(?:dot|DOT)\s+|&#(?:46|x2[eE]);|&period;)"
_AT = r"(?:@|＠|\s@\s|\s*[\[({]\s*(?:at|AT|@|arroba)\s*[\])}]\s*|\s+(?:at|AT)\s+|&#(?:64|x40);|&commat;|%40)"
_PLAIN_EMAIL = re.compile(r"(?<![\w.+\-%])(?P<u>[^\W_][\w.+\-]*|[\w][\w.+\-]*)(?:@|＠|&#(?:64|x40);|&commat;|%40|\s@\s)(?P<h>(?:[^\W_](?:[\w\-]*[^\W_])?\.)+[^\W\d_]{2,})(?![\w\-])(?!\.\w)", re.I)
_SPELT_EMAIL = re.compile(rf"(?<![\w.+\-@/])(?P<u>[^\W_][\w+\-]*(?:{_DOT}[\w+\-]+)*)(?P<at>{_AT})(?P<h>[^\W_][\w\-]*(?:{_DOT}[^\W_][\w\-]*)+)(?![\w@])")
_NO_MAIL_BEFORE = re.compile(r"(?:[a-zA-Z][\w+.\-]*://\S*|\b(?:git\s+clone|git\s+remote\s+add\s+\S+|ssh|scp|rsync|sftp)\s+(?:-\S+\s+(?:\S+\s+)?)*|@[\w\-]+/)$")

_PHONE = re.compile(
    r"""(?x)(?<![\w./:\#@+\-])(?:
      \+\d{1,3}[ .\-]?\(0\)[ .\-]?\d{1,4}(?:[ .\-]?\d{2,8}){1,4}
    | \+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?)(?:[ .\-/]?\d{2,8}){1,5}
    | (?:1[ .\-])?\(\d{3}\)[ ]?\d{3}[ .\-]\d{4}
    | (?:1[ .\-])?[2-9]\d{2}(?P<s>[.\- ])\d{3}(?P=s)\d{4}
    | 0\d[ .]\d{2}[ .]\d{2}[ .]\d{2}[ .]\d{2}
    | 0\d{2,4}[ \-/]\d{3,8}(?:[ \-]\d{2,8}){0,2}
    | 0\d{9,10}
    | 00\d{2}[ ]?\d{2,4}(?:[ ]?\d{2,4}){2,4}
    )(?:\s?(?:ext\.?|x|extension|Durchwahl)\s?\d{1,5})?(?![\w]|[.\-:/]\d)"""
)
_NO_PHONE_BEFORE = re.compile(r"(?i)(?:\b(?:offsets?|batch|no|nr|job|id|ids|build|epoch|version|port|line|row|rows|range|bytes?|commit|ticket|order|invoice|serial|sku|isbn|size|at)\b[\s.:#=]*)$")
_NO_PHONE_AFTER = re.compile(r"(?i)\s*(?:overlap|bytes|ms|rows|lines|times|seconds|requests)\b")

_LABEL = (
    r"(?:social\s+security\s+(?:number|no\.?)|ssn|dni|nie|nif|nino|ni\s+number|national\s+insurance\s+(?:number|no\.?)|steuer-?id(?:entifikationsnummer)?|pesel|nir|tax\s+id|national\s+id(?:entity)?(?:\s+(?:number|no\.?|card))?"
    r"|passport(?:\s+(?:number|no\.?))?|reisepass(?:nummer)?|pasaporte|passeport|driver'?s?\s+licen[cs]e(?:\s+(?:number|no\.?))?|driving\s+licen[cs]e(?:\s+(?:number|no\.?))?|personal(?:ausweis)?(?:\s*nummer)?|personnummer|identity\s+card(?:\s+(?:number|no\.?))?|id\s+card(?:\s+(?:number|no\.?))?|aadhaar|cpf)"
)
_IDENTITY = re.compile(
    rf"""(?x)(?<![\w\-])(?i:{_LABEL})(?:\s+(?:is|was|no\.?|number))?\s*[:=\#]?\s*(?P<v>(?=[A-Za-z0-9 .\-/]*\d{{2}})[A-Za-z]{{0,2}}\d[\dA-Za-z]*(?:[ .\-/]?\d[\dA-Za-z]*)*(?:[ \-]?[A-Za-z](?![A-Za-z]))?|(?P<w>[A-Z]{{2}}(?:\ ?\d{{2}}){{3}}\ ?[A-D]|[A-Z]{{1,2}}\d{{6,8}}[A-Z]?))(?![A-Za-z0-9])
    | (?<![\w.\-])(?P<x>[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NP-TQW-Z]\ ?\d{{2}}\ ?\d{{2}}\ ?\d{{2}}\ ?[A-D]|\d{{8}}[A-HJ-NP-TV-Z]|\d{{2}}\.\d{{3}}\.\d{{3}}-[A-Z])(?![\w\-])"""
)

_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd|Terrace|Ter|Place|Pl|Square|Sq|Way|Close|Crescent|Cres|Parkway|Pkwy|Circle|Cir|Trail|Highway|Hwy|Gardens|Grove|Row|Mews|Walk)"
_CAP = r"[^\W\d_a-z][^\W\d_]*(?:['’\-][^\W\d_]+)*"
_ADDRESS = re.compile(
    rf"""(?x)(?<![\w./\#\-])(?:
      (?:(?:Flat|Apt|Apartment|Unit|Suite)\.?\ \d+[A-Za-z]?\s*,\s*)?\d{{1,5}}[A-Za-z]?,?\ (?:[NSEW]\.?\ )?(?:(?:{_CAP}|\d+(?:st|nd|rd|th))\ ){{1,3}}{_STREET}\b\.?
    | \d{{1,4}}(?:\ ?(?:bis|ter|[a-zA-Z]))?,?\ (?:rue|avenue|av\.|boulevard|bd|chemin|place|impasse|allée|allee|quai|route|cours|passage|square|villa|sentier|faubourg)\ (?:(?:d[eu]s?|de\ la|de\ l['’]|d['’]|l['’]|le|la|les|du|aux?)\ ?)*{_CAP}(?:[ \-]{_CAP})*
    | (?:ul\.|ulica|al\.|aleja|pl\.|os\.)\ ?{_CAP}(?:\ {_CAP})*\ \d+[A-Za-z]?(?:\s?(?:/|m\.)\s?\d+)?
    | (?:C/|Calle|Avda\.?|Avenida|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carrer|Rua|Largo|Travessa|Praça|Via|Viale|Piazza|Corso)\ ?(?:(?:de|del|da|do|dos|das|la|las|los|el|di)\ )*{_CAP}(?:\ (?:(?:de|del|la|las|los|y)\ )*{_CAP})*\s*,?\s*(?:n[.º°o]*\ ?)?\d+[A-Za-z]?
    | (?:(?:Am|An\ der|Auf\ der|Auf\ dem|Im|In\ der|Zum|Zur|Unter\ den|Alte|Alter|Neue|Obere|Untere|Große|Kleine)\ )?(?:[^\W\d_]+(?:-[^\W\d_]+)*-?(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|hof|chaussee|graben|markt|pfad|stieg)|{_CAP}\ (?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz|Ring|Damm|Ufer))\ \d+\s?[a-zA-Z]?(?![\w])
    )"""
)
_NO_ADDRESS_AFTER = re.compile(r"\s+(?:icons?|missing|sprites?|lines?|files?|tests?|errors?|times)\b")


#: Characters read as their plain counterparts, one for one.
_PLAIN = str.maketrans({**{c: " " for c in "        　"}, **{c: "-" for c in "‐‑‒–−"}, **{chr(0xFF10 + i): str(i) for i in range(10)}, "＠": "@", "．": "."})


def _fold(s: str) -> str:
    return unicodedata.normalize("NFC", _UNESCAPE.sub(lambda m: chr(int(m[1], 16)), s)).casefold()


def _spellings(name: str) -> set[str]:
    """A given name folded, without accents, and with accents written out."""
    low = _fold(name)
    bare = "".join(c for c in unicodedata.normalize("NFKD", low.replace("ø", "o").replace("ł", "l")) if not unicodedata.combining(c))
    out = low
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ø", "oe"), ("å", "aa"), ("ß", "ss"), ("æ", "ae")):
        out = out.replace(a, b)
    out = "".join(c for c in unicodedata.normalize("NFKD", out) if not unicodedata.combining(c))
    return {low, bare, out}


def _words_back(text: str, at: int, n: int) -> int:
    """Where the ``n`` words before ``at`` begin, at most at the beginning of the line; words may be of any length."""
    line = text.rfind("\n", 0, at) + 1
    while n and at > line:
        at = max(line, text.rfind(" ", line, at), text.rfind("\t", line, at))
        n -= 1
    return at


#: What tells a name apart from its words (fixed values): titles, trailers, closing formulas.
_TITLES = r"(?:Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Herrn?|Frau|Señora?|Sra|Mme|Mlle|Monsieur|Madame|Pani)\b\.?"
_TRAILERS = r"(?:Signed-off|Reviewed|Reported|Acked|Tested|Suggested|Co-authored|Co-Authored)-[bB]y:"
_CLOSINGS = r"(?:Thanks|Thank you|Regards|Best regards|Kind regards|Best wishes|Cheers|Sincerely|Cordialement|Bien à vous|Saludos|Un saludo|Viele Grüße|Mit freundlichen Grüßen|Pozdrawiam)[,!.]?"
_NAME_WORD = r"[^\W\d_a-z](?:[^\W\d_]|[-'’](?=[^\W\d_]))+"
_GIVEN_FAMILY = rf"{_NAME_WORD}(?:[ \t]+[^\W\d_]\.)?(?:[ \t]+(?:van|von|de|da|di|del|der|la|le|bin|al|el|ter|ten))*[ \t]+{_NAME_WORD}"
_BY_CONTEXT = re.compile(
    rf"(?:(?<!\w){_TITLES}[ \t]+|(?<!\w){_TRAILERS}[ \t]*|(?:^|\n)[ \t>*]*{_CLOSINGS}[ \t]*\n[\s>*]*(?:[-–—]+[ \t]*)?)(?P<n>{_GIVEN_FAMILY})(?![\w@(])"
    rf"|(?<![\w@./])(?P<m>{_GIVEN_FAMILY})(?=[ \t]*<[^<>\s@]+@[^<>\s]+>)"
)


#: Without these there is no name told by its context.
_CONTEXT_HINT = re.compile(rf"{_TITLES}|-[bB]y:|{_CLOSINGS}|<[^<>\s@]+@")


class Finder:
    """Spans of personal information in a text."""

    def __init__(self, female: list[str] = FEMALE, male: list[str] = MALE):
        self.gender = {s: g for g, names in (("f", female), ("m", male)) for n in names for s in _spellings(n)}

    def emails(self, text: str) -> Iterator[tuple[int, int]]:
        taken: list[tuple[int, int]] = []
        for m in _PLAIN_EMAIL.finditer(text):
            a = m.start("u")
            head = text[_words_back(text, a, 6) : a]
            if m[0].count("%40") and "=" in head[_words_back(head, len(head), 1) :]:
                pass  # a query parameter of a link
            elif _NO_MAIL_BEFORE.search(head) or text[a - 1 : a] == ":" and "://" in text[_words_back(text, a, 1) : a]:
                continue
            if m["u"] == "git" or text[m.end() : m.end() + 1] == ":" and re.match(r":[\w./\-]*[a-zA-Z]", text[m.end() : m.end() + 20]):
                continue
            taken.append((a, m.end()))
        for m in _SPELT_EMAIL.finditer(text):
            spelt_dot = re.search(r"(?i)dot|punkt|punto|point|&", m["h"] + m["u"])
            if "@" in m["at"].strip() and not spelt_dot and " " not in m["at"]:
                continue
            if not (spelt_dot or re.search(r"[\[({]", m["at"])):
                continue
            if not any(x < m.end() and m.start() < y for x, y in taken):
                taken.append(m.span())
        return iter(sorted(taken))

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, type) in order; no two overlap."""
        if not text:
            return []
        text = text.translate(_PLAIN)
        out: list[tuple[int, int, str]] = []

        def free(a: int, z: int) -> bool:
            return not any(x < z and a < y for x, y, _ in out)

        for a, z in self.emails(text):
            out.append((a, z, EMAIL))
        for m in _IDENTITY.finditer(text):
            group = "v" if m["v"] else "x"
            a, z = m.span(group)
            if sum(c.isdigit() for c in m[group]) >= 5 and free(a, z):
                out.append((a, z, IDENTITY))
        for m in _PHONE.finditer(text):
            head = text[max(0, m.start() - 16) : m.start()]
            n = sum(c.isdigit() for c in m[0])
            if 7 <= n <= 20 and not _NO_PHONE_BEFORE.search(head) and not _NO_PHONE_AFTER.match(text, m.end()) and free(*m.span()):
                out.append((*m.span(), PHONE))
        for m in _ADDRESS.finditer(text):
            if not _NO_ADDRESS_AFTER.match(text, m.end()) and free(*m.span()):
                out.append((*m.span(), ADDRESS))
        names = [(a, z) for a, z in self._names(text) if free(a, z)]
        for m in _BY_CONTEXT.finditer(text) if _CONTEXT_HINT.search(text) else ():
            a, z = m.span("n" if m["n"] else "m")
            if free(a, z) and not any(x < z and a < y for x, y in names):
                names.append((a, z))
        out += [(a, z, NAME) for a, z in names]
        return sorted(out)

    def _names(self, text: str) -> Iterator[tuple[int, int]]:
        tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
        used = -1
        for k, (a, z, w) in enumerate(tokens):
            if _fold(w) not in self.gender or a < used:
                continue
            if text[a - 1 : a] in ("@", "/", "_", "\\", "#", "+", "=") and text[a - 1 : a] != "=" or (text[a - 1 : a] == "." and text[a - 2 : a - 1].isalnum()) or (text[a - 1 : a] == "-" and text[a - 2 : a - 1].isalnum()):
                continue
            if text[z : z + 1] in ("@", "_", "/", "+") or (text[z : z + 1] in ".-" and text[z + 1 : z + 2].isalnum()) or text[z : z + 1].isdigit():
                continue
            span = self._forward(text, tokens, k) or self._backward(text, tokens, k, used)
            if span and not _THING_AFTER.match(text, span[1]):
                used = span[1]
                yield span

    def _family(self, text: str, token: tuple[int, int, str], given: str) -> bool:
        a, z, w = token
        low = _fold(w)
        if len(low) < 3 or low in _NO_FAMILY or text[z : z + 1] in ("@", "_", "/", "(") or (text[z : z + 1] == "." and text[z + 1 : z + 2].isalnum()) or text[z : z + 1].isdigit():
            return False
        plain = _UNESCAPE.sub(lambda m: chr(int(m[1], 16)), w)
        first = _UNESCAPE.sub(lambda m: chr(int(m[1], 16)), given)
        return plain[0].isupper() or first.islower()

    def _forward(self, text: str, tokens: list, k: int) -> tuple[int, int] | None:
        a, z, w = tokens[k]
        j = k + 1
        if j < len(tokens) and len(tokens[j][2]) == 1 and re.fullmatch(r"[ \t]+", text[z : tokens[j][0]]) and re.match(r"\.?[ \t]", text[tokens[j][1] :]):
            z = tokens[j][1] + (text[tokens[j][1] : tokens[j][1] + 1] == ".")
            j += 1
        if j < len(tokens) and re.fullmatch(r"[ \t]+", text[z : tokens[j][0]]) and self._family(text, tokens[j], w):
            return a, tokens[j][1]
        return None

    def _backward(self, text: str, tokens: list, k: int, used: int) -> tuple[int, int] | None:
        a, z, w = tokens[k]
        if k == 0 or tokens[k - 1][0] < used:
            return None
        pa_, pz, p = tokens[k - 1]
        gap = text[pz:a]
        plain = _UNESCAPE.sub(lambda m: chr(int(m[1], 16)), p)
        if _fold(p) in _NO_FAMILY or len(plain) < 3 or text[pa_ - 1 : pa_] in ("@", "/", "_", ".", "-") or not (plain[0].isupper() or w.islower()):
            return None
        if re.fullmatch(r",[ \t]*", gap) or (re.fullmatch(r"[ \t]+", gap) and (plain.isupper() or plain[0].isupper() and plain.lower() not in _NO_FAMILY)):
            return pa_, z
        return None


PLACEHOLDER = {EMAIL: "[EMAIL]", PHONE: "[PHONE]", IDENTITY: "[ID_NUMBER]", ADDRESS: "[ADDRESS]", NAME: "[PERSON]"}

#: Vowels that have umlauts.
_UMLAUT = "aou"
#: Kinds of words that are names, and what their surrogates depend on.
_NAMED = {"family": "family", "user": "family"}
#: Sets of letters that stand for each other.
_LETTERS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
#: Words of an address that tell its form, folded (fixed values).
_FORM = set(
    """street st avenue ave road rd lane ln drive dr court ct boulevard blvd terrace ter place pl square sq way close crescent cres parkway pkwy circle cir trail highway hwy gardens grove row mews walk
    nd rd th flat apt apartment unit suite bis rue av bd chemin impasse allée allee quai route cours passage villa sentier faubourg de du des la le les aux au ul ulica al aleja os calle avda avenida plaza pza paseo camino ronda
    travesía carrer rua largo travessa praça via viale piazza corso del da do dos das las los el di no am an der auf dem im in zum zur unter den alte alter neue obere untere grosse kleine strasse str weg gasse platz ring damm ufer""".split()
)
_COMPOUND = re.compile(r"(?i)(?P<stem>.{2,}?-?)(?P<tail>straße|strasse|str|weg|gasse|allee|platz|ring|damm|ufer|steig|hof|chaussee|graben|markt|pfad|stieg)")


@lru_cache(10_000)
def _alphabet(low: str) -> str:
    """The letters that may stand for a lower-case letter, itself included; '' if none."""
    for s in _LETTERS:
        if low in s:
            return s
    if len(low) != 1 or unicodedata.category(low) not in ("Ll", "Lo"):
        return ""
    k = ord(low)
    block = range(0x4E00, 0xA000) if 0x4E00 <= k < 0xA000 else range(0x1100, 0x1113) if 0x1100 <= k < 0x1113 else range(0x1161, 0x1176) if 0x1161 <= k < 0x1176 else range(0x11A8, 0x11C3) if 0x11A8 <= k < 0x11C3 else range(k & ~127, (k & ~127) + 128)

    def fits(c: str) -> bool:
        up = c.upper()
        return unicodedata.category(c) == unicodedata.category(low) and unicodedata.normalize("NFKD", c) == c and (len(up) == 1 and up != c and up.lower() == c if low.upper() != low else up == c)

    own = "".join(c for c in map(chr, block) if fits(c) and not any(c in s for s in _LETTERS))
    return own if low in own and len(own) > 2 else ""


_WORD = re.compile(r"[0-9]+|(?:[^\W\d_][\u0300-\u036f]*)+")


def _form(word: str) -> bool:
    return unicodedata.normalize("NFC", word).casefold() in _FORM


class Surrogates:
    """Keyed replacements of the same type, script and format."""

    def __init__(self, key: bytes, female: list[str] = FEMALE, male: list[str] = MALE):
        self.key = key
        self.known: dict[tuple[str, str], str] = {}
        both = [n for n in UNISEX if n in female or n in male]
        self.given = {"f": [n for n in female if n not in both], "m": [n for n in male if n not in both], "u": both}
        self.gender = Finder(self.given["f"], self.given["m"]).gender | {s: "u" for n in both for s in _spellings(n)}
        self.prefixes = sorted((n for n in self.gender if len(n) > 2 and n.isascii()), key=len, reverse=True)

    def _shift(self, tweak: str, n: int) -> int:
        return int.from_bytes(hmac.new(self.key, tweak.encode(), hashlib.sha256).digest()[:8], "big") % n

    def _turns(self, x: list[int], sizes: list[int], shape: str, back: bool) -> None:
        """Three keyed turns over ``x``, or their inverse."""
        n = len(x)
        turns = [(0, range(n)), (1, range(n - 1, -1, -1)), (2, range(n))]
        for turn, order in reversed(turns) if back else turns:
            done = ""
            for i in order:
                shift = self._shift(f"{shape}#{turn}#{i}#{done}", sizes[i])
                new = x[i] if back else (x[i] + shift) % sizes[i]
                x[i] = (x[i] - shift) % sizes[i] if back else new
                done += f"{new},"

    @staticmethod
    def _units(value: str, kind: str) -> tuple[list[tuple[int, str]], str]:
        """(place and alphabet of each letter or digit of ``value`` (decomposed), shape of the rest). Accents are no part of
        the shape; in names a vowel and its umlaut sign, or the e that stands for it, are one unit."""
        units, bare, i = [], [], 0
        while i < len(value):
            c = value[i]
            mark = value[i + 1 : i + 2]
            umlaut = kind in _NAMED and c.lower() in _UMLAUT and (mark == "\u0308" or mark in ("e", "E") and not unicodedata.combining(value[i + 2 : i + 3] or " "))
            if letters := _UMLAUT if umlaut else _alphabet(c.lower()):
                units.append((i, letters))
                bare.append(":" if umlaut else ".")
            elif not unicodedata.combining(c):
                bare.append(c)
            i += 2 if umlaut else 1
        return units, _NAMED.get(kind, kind) + "".join(bare) + "|" + "".join(s[0] for _, s in units)

    def _permute(self, value: str, form: tuple[list[tuple[int, str]], str], back: bool = False) -> str:
        """A bijection without fixed points of the units of ``value`` among values of the same ``form``, or its inverse: a
        step that moves every value, seen through the keyed turns, so that all its cycles are as long as the first alphabet."""
        units, shape = form
        if not units:
            return value
        x, sizes = [s.index(value[i].lower()) for i, s in units], [len(s) for _, s in units]
        self._turns(x, sizes, shape, False)
        steps = [k for k in range(1, sizes[0]) if math.gcd(k, sizes[0]) == 1] if sizes[0] < 100 else [1]
        step = steps[self._shift(f"{shape}#step", len(steps))]
        x[0] = (x[0] + (-step if back else step)) % sizes[0]
        self._turns(x, sizes, shape, True)
        out = list(value)
        for (i, s), v in zip(units, x, strict=True):
            out[i] = s[v].upper() if value[i] != value[i].lower() else s[v]
        return "".join(out)

    def _distinct(self, value: str, kind: str, taken: Callable[[str], bool] = lambda s: False) -> str:
        """The surrogate of ``value``; those that are ``taken``, or would be read as another form, are walked over, as they are
        no values of this kind."""
        new = self.known.get((kind, value))
        if new is None:
            plain = unicodedata.normalize("NFD", value)
            form = self._units(plain, kind)
            no_value = lambda x: taken(unicodedata.normalize("NFC", x)) or self._units(x, kind) != form
            new = self._permute(plain, form)
            while no_value(new) and new != plain:
                new = self._permute(new, form)
            again = self._permute(new, form, True)
            while no_value(again):
                again = self._permute(again, form, True)
            if again != plain:
                raise ValueError(f"a surrogate of kind {kind} stands for two values")
            new = unicodedata.normalize("NFC", new)
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[kind, value] = new
        return new

    def _address(self, m: re.Match) -> str:
        w = m[0]
        if w[0].isdigit():
            return self._distinct(w, "house")
        if len(w) == 1 or _form(w):
            return w
        if c := _COMPOUND.fullmatch(w):
            return self._distinct(c["stem"], "street") + c["tail"]
        return self._distinct(w, "street", lambda s: _form(s) or _COMPOUND.fullmatch(s) is not None)

    def _given(self, w: str) -> str | None:
        """The surrogate of a given name; None if it is none."""
        g = self.gender.get(_fold(w))
        if not g:
            return None
        names = self.given[g]
        at = next((i for i, n in enumerate(names) if _fold(w) == _fold(n)), None)
        at = next(i for i, n in enumerate(names) if _fold(w) in _spellings(n)) if at is None else at
        return names[(at + 1 + self._shift("given" + g, len(names) - 1)) % len(names)]

    def _split(self, w: str) -> int:
        """Where the family name begins in a user part of a given and a family name in one word; 0 if it is not so."""
        low = w.lower()
        return next((len(p) for p in self.prefixes if low.startswith(p) and len(low) - len(p) > 2), 0)

    def _named(self, w: str) -> bool:
        """Whether a word is or begins with a given name, and so is no surrogate of a family name."""
        return _fold(w) in self.gender or self._split(w) > 0

    def _user(self, m: re.Match) -> str:
        """The surrogate of a word of a user part, as of the name that it is."""
        w = m[0]
        if w[0].isdigit():
            return self._distinct(w, "digits")
        plain = lambda n: max(_spellings(n), key=lambda x: (x.isascii(), len(x)))
        if self._given(w) is not None:
            new = plain(self._given(w))
        elif at := self._split(w):
            new = plain(self._given(w[:at])) + self._distinct(w[at:].lower(), "user", self._named)
        else:
            return self._distinct(w, "user", self._named)
        return new.upper() if w.isupper() else new[:1].upper() + new[1:] if w[:1].isupper() else new

    def of(self, value: str, kind: str) -> str:
        value = unicodedata.normalize("NFC", value)
        if kind == NAME:
            def word(m: re.Match) -> str:
                w = m[0]
                new = self._given(w)
                if new is None:
                    return self._distinct(w, "initial" if len(w) == 1 else "family", self._named)
                return new.upper() if w.isupper() else new.lower() if w.islower() else new[:1].upper() + new[1:]

            return _TOKEN.sub(word, unicodedata.normalize("NFC", _UNESCAPE.sub(lambda m: chr(int(m[1], 16)), value)))
        if kind == EMAIL:
            m = re.search(_AT, value)
            user, rest = (value[: m.start()], value[m.start() :]) if m else (value, "")
            head, dot, tail = rest.rpartition(".")
            return _WORD.sub(self._user, user) + (re.sub(rf"^({_AT})(.*)$", lambda x: x[1] + self._distinct(x[2], "host"), head, flags=re.S) + dot + tail if dot else rest)
        if kind == ADDRESS:
            return _WORD.sub(self._address, value)
        return self._distinct(value, kind)


def _map(texts: DataFrame, schema: str, names: list[str], rows_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = rows_of()
        for batch in batches:
            rows = [r for t, i, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) for r in work(t, i, x)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
            kinds = [types[p.split()[1]] for p in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return texts.mapInArrow(run, schema)


#: Texts without these hold none of the types.
_MAY_BE = r"@|%40|(?i:\bat\b)|&#|&commat|\d|＠|\p{L}{3}[,]? \p{L}{3}"


def _texts(columns: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    parts = [df.select(F.lit(t).alias("table_name"), F.col(k).cast("bigint").alias("record_id"), F.col(c).cast("string").alias("text")) for t, df, k, c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("text").rlike(_MAY_BE))


def occurrences(columns: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(table_name, record_id, pii_type, ordinal) of each occurrence in ``columns``: (table name, table, id column, text column)."""

    def rows_of():
        finder = Finder()

        def work(t, i, x):
            seen: Counter = Counter()
            for _, _, kind in finder.spans(x):
                seen[kind] += 1
                yield t, i, kind, seen[kind]

        return work

    return _map(_texts(columns), "table_name string, record_id bigint, pii_type string, ordinal int", ["table_name", "record_id", "pii_type", "ordinal"], rows_of)


def replaced(columns: list[tuple[str, DataFrame, str, str]], key: bytes | None = None) -> DataFrame:
    """(table_name, record_id, text): the texts with personal information replaced by typed placeholders, or surrogates under ``key``."""

    def rows_of():
        finder, surrogates = Finder(), Surrogates(key) if key else None

        def work(t, i, x):
            spans = finder.spans(x)
            if spans:
                out, at = [], 0
                for a, z, kind in spans:
                    out += [x[at:a], surrogates.of(x[a:z], kind) if surrogates else PLACEHOLDER[kind]]
                    at = z
                yield t, i, "".join([*out, x[at:]])

        return work

    return _map(_texts(columns), "table_name string, record_id bigint, text string", ["table_name", "record_id", "text"], rows_of)
