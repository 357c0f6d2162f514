"""Personal information in many notations, look-alikes that are none, placeholders and surrogates."""

import itertools
import unicodedata

import pytest

from changeprism.llm.pii import ADDRESS, EMAIL, IDENTITY, NAME, PHONE, Finder, Surrogates, occurrences, replaced

FIND = Finder()
CASES = [
    ("Contact: a.b+c@mail.silver.invalid now", [EMAIL]), ("cc x_y (at) orchid (dot) example", [EMAIL]), ("cc rob AT lumen DOT example", [EMAIL]), ("robert dot kr at slate dot example", [EMAIL]),
    ("<mailto:zoe.b@nova.example>", [EMAIL]), ("w&#64;toez.tarn.example", [EMAIL]), ("https://d.test/reset?email=anais.w%40raven.test", [EMAIL]), ("m.s @ zephyr.invalid", [EMAIL]),
    ("git clone git@git.silver.example:a/b.git", []), ("https://svc:pw@git.x.example/x.git", []), ("npm i @a/b@1.2.3 and pin `x@4.6.0`", []), ("@Override and @team-x please", []),
    ("Call +1 977 555 0198 or (667) 555-0139", [PHONE, PHONE]), ("0491 570 999", [PHONE]), ("+44 (0)20 7946 0728", [PHONE]), ("+33.1.99.00.29.39", [PHONE]), ("581-555-0158 ext. 577", [PHONE]), ("206 555 0128", [PHONE]), ("list: 645\u00a0555\u00a00173 / x", [PHONE]),
    ("job id 906421573 was retried", []), ("offsets 753 223 2941 overlap", []), ("epoch 1617059393172 is wrong", []), ("batch no. 792-41-2793 of x", []), ("ran on 10.191.42.112:2308", []), ("Build 20231128.0666 took 975.27 s", []),
    ("SSN 975-45-3260", [IDENTITY]), ("ssn: 920 50 5791, x", [IDENTITY]), ("social security number 995152800 was", [IDENTITY]), ("NI number QQ 89 56 88 D was", [IDENTITY]), ("Steuer-ID 77 139 880 718.", [IDENTITY]),
    ("dni 91.448.117-W is", [IDENTITY]), ("passport no. C7959930.", [IDENTITY]), ("driver licence F633-3814-4373 is", [IDENTITY]), ("national id 561112-57795.", [IDENTITY]),
    ("237 Wren Drive, Tolverne, TX 21211", [ADDRESS]), ("Flat 40, 89 Larkspur Terrace", [ADDRESS]), ("5 rue des Tanneurs, 35490 Valdemora", [ADDRESS]), ("ul. Lipowa 67/1, 85-143 Ostwald", [ADDRESS]),
    ("Avda. Las Moras 1, 1º, 27316 V", [ADDRESS]), ("C/ Trinquete 57, 5º", [ADDRESS]), ("Lindenweg 9b", [ADDRESS]), ("Birkenstr. 17a,\n12744 X", [ADDRESS]), ("14 Lane icons missing", []),
    ("Thanks to Robert Lélvuntane for", [NAME]), ("FLEIRVAAC Margarete", [NAME]), ("Faibbenman, Christopher and Zoë Troudlilun both", [NAME, NAME]), ("magdalena lolbialey confirmed", [NAME]), ("ask Samuel J. Dótriayk before", [NAME]),
    ('"name": "S\\u00f8ren Kr\\u00e1lkunski"', [NAME]), ("the Jasmine Runner setting is unrelated", []), ("Robert confirmed it", []), ("contact Mateusz C. Seissiaman, 186 Juniper St., B", [NAME, ADDRESS]), ("robert.kr and @robert-kr", []), ("", []),
]


@pytest.mark.parametrize(("text", "kinds"), CASES)
def test_kinds(text, kinds):
    assert [k for _, _, k in FIND.spans(text)] == kinds, FIND.spans(text)


def test_surrogates_keep_form_and_distinctness():
    s = Surrogates(b"k")
    numbers = [f"{n:03d}-55-1234" for n in range(1000)]
    out = [s.of(n, IDENTITY) for n in numbers]
    assert len(set(out)) == len(out) and all(a != b and len(a) == len(b) and a[3] == a[6] == "-" for a, b in zip(numbers, out, strict=True))
    names = ["Zoë Lentaretti", "ZOË LENTARETTI", "Lentaretti, Zoë", "Robert Lélvuntane"]
    new = [s.of(n, NAME) for n in names]
    assert new[0].upper() == new[1] and new[0].split()[::-1] == new[2].replace(",", "").split() and new[3] != names[3]
    assert FIND.gender[new[0].split()[0].casefold()] == "f" and FIND.gender[new[3].split()[0].casefold()] == "m"
    pairs = ["".join(p) + "@x.example" for p in itertools.product("abcdefgh", repeat=3)]
    assert len({s.of(p, EMAIL) for p in pairs}) == len(pairs) and s.of("a@b.example", EMAIL).endswith(".example")
    assert s.of("a@b.example", EMAIL) != Surrogates(b"other").of("a@b.example", EMAIL)


def test_surrogates_replace_street_names():
    s = Surrogates(b"k")
    for text, hidden, kept in (
        ("12 Elm Street", ("Elm", "12"), ("Street",)), ("12 ELM STREET", ("ELM",), ("STREET",)), ("Flat 40, 89 Larkspur Terrace", ("Larkspur", "40", "89"), ("Flat", "Terrace")), ("5 rue des Tanneurs", ("Tanneurs",), ("rue des",)),
        ("ul. Lipowa 67/1", ("Lipowa",), ("ul. ", "/")), ("Avda. Las Moras 1", ("Moras",), ("Avda. Las ",)), ("Lindenweg 9b", ("Linden", "9"), ("weg", "b")), ("Birkenstr. 17a", ("Birken",), ("str. ",)), ("Große Straße 7", ("7",), ("Große Straße",)),
    ):
        new = s.of(text, ADDRESS)
        assert len(new) == len(text) and not [h for h in hidden if h in new] and not [k for k in kept if k not in new], (text, new)
    words = ["".join(p).capitalize() for p in itertools.product("lmrt", "aeo", "lmrw", "ae")] + ["Lo", "Row", "Way", "Boring", "Ring"]
    out = [s.of(f"1 {w} Road", ADDRESS) for w in words]
    assert len(set(out)) == len(words)


def test_surrogates_have_no_fixed_points():
    for key in range(40):
        s = Surrogates(bytes([key]))
        for values, kind in ((list("0123456789"), "house"), (list("aeiou"), "initial"), ([f"{n:02d}" for n in range(100)], "house")):
            new = [s._distinct(v, kind) for v in values]
            assert sorted(new) == sorted(values) and not [v for v, n in zip(values, new, strict=True) if v == n]


def test_surrogates_keep_accents_and_scripts_apart():
    s = Surrogates(b"k")
    families = ["Müller", "Muller", "Mueller", "Müllér", "Søby", "Soby", "Wałęsa", "Walesa", "Παππάς", "Παππας", "王小明", "王小萌", "김민수", "Иванёв", "Иванев", "McDonald", "Mcdonald"]
    new = [s.of(f, NAME) for f in families]
    assert len(set(new)) == len(new) and not set(new) & set(families)
    marks = lambda w: [unicodedata.combining(c) for c in unicodedata.normalize("NFD", w) if unicodedata.combining(c)]
    cases = lambda w: [c.isupper() for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)]
    assert all(marks(a) == marks(b) and cases(a) == cases(b) for a, b in zip(families, new, strict=True))
    assert s.of("ø", NAME) != "ø" and s.of("łø", NAME) != "łø" and s.of("Maria", NAME) != s.of("María", NAME)
    assert s.of(unicodedata.normalize("NFD", "Müller"), NAME) == new[0]


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Signed-off-by: Ngozi Okafor <n@x.example>", "Ngozi Okafor"), ("please ask Dr. Hiroshi Tanaka first", "Hiroshi Tanaka"), ("It works.\n\nKind regards,\nSiobhan O'Murphy\n", "Siobhan O'Murphy"), ("cc Ngozi van der Okafor <n@x.example>", "Ngozi van der Okafor"),
        ("Frau Aylin Yıldız called", "Aylin Yıldız"),
    ],
)
def test_names_told_by_their_context(text, name):
    assert name in [text[a:z] for a, z, k in FIND.spans(text) if k == NAME]


def test_no_names_by_capitals_alone():
    for text in ("Silver Lantern is a theme", "Thanks\nto the Build Team", "Signed-off-by: bot", "Open <https://x.example> in Safari Browser", "Regards,\nthe team"):
        assert FIND.spans(text) == [], text


def test_addresses_behind_long_paths():
    for n in (5, 80, 5000):
        assert FIND.spans("see https://git.example/" + "p" * n + "/john@host.com now") == []
        assert [k for _, _, k in FIND.spans("see https://git.example/" + "p" * n + " john@host.com now")] == [EMAIL]
        assert [k for _, _, k in FIND.spans("https://d.test/" + "p" * n + "?m=a.w%40raven.test")] == [EMAIL]
    assert FIND.spans("git clone " + "-b " + "x" * 200 + " git@h.example:a/b.git") == []


def test_a_person_stays_one_person():
    s = Surrogates(b"k")
    given, family = s.of("Anna Müller", NAME).split()
    fold = lambda w: w.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("Ä", "Ae").replace("Ö", "Oe").replace("Ü", "Ue")
    assert s.of("Anna Mueller", NAME) == f"{given} {fold(family)}"
    for user in ("anna.mueller", "mueller_anna", "annamueller42", "Anna.Mueller"):
        new = s.of(f"{user}@x.example", EMAIL).split("@")[0].lower()
        assert fold(family).lower() in new and "".join(c for c in unicodedata.normalize("NFKD", given) if not unicodedata.combining(c)).lower() in new, (user, new, given, family)
    assert FIND.gender["andrea"] and s.gender["andrea"] == "u" and s.of("Andrea Rossi", NAME).split()[0] in ("Camille", "Claude", "Jean")


def test_many_values_of_each_type_stay_distinct():
    s = Surrogates(b"key")
    syllables = ["".join(p) for p in itertools.product("bdfglmnrst", "aeiou")]
    families = ["".join(p).capitalize() for p in itertools.islice(itertools.product(syllables, syllables, syllables), 0, 125_000, 6)]
    users = [f"{f.lower()}{i % 10}" for i, f in enumerate(families)]
    for values, kind, wrap in ((families, NAME, "Robert {}"), (users, EMAIL, "{}@x.example"), (families[:10_000], ADDRESS, "12 {} Street"), ([f"{n:05d}1234" for n in range(20_000)], PHONE, "+{}"), ([f"{n:05d}" for n in range(20_000)], IDENTITY, "SV {}")):
        own = [wrap.format(v) for v in values]
        new = [s.of(v, kind) for v in own]
        assert len(set(new)) == len(own) and not [v for v, n in zip(own, new, strict=True) if v == n]


def test_a_collision_is_an_error(monkeypatch):
    s = Surrogates(b"k")
    monkeypatch.setattr(s, "_turns", lambda x, sizes, shape, back: x.__setitem__(0, 0))
    with pytest.raises(ValueError, match="two values"):
        [s.of(n, IDENTITY) for n in ("123", "923")]


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.example, c@d.example a@b.example", "x"), (4, "w " * 100_000 + "a@b.example", "x"), (None, "a@b.example", "x")]
    df = spark.createDataFrame(rows, "id long, body string, ordinal string")
    columns = [("t", df, "id", "body")]
    got = sorted((r.record_id or 0, r.pii_type, r.ordinal) for r in occurrences(columns).collect())
    assert got == [(0, EMAIL, 1), (3, EMAIL, 1), (3, EMAIL, 2), (3, EMAIL, 3), (4, EMAIL, 1)]
    assert {r.text for r in replaced(columns).collect() if r.record_id == 3} == {"[EMAIL], [EMAIL] [EMAIL]"}
    third = next(r.text for r in replaced(columns, b"k").collect() if r.record_id == 3).split(" ")
    assert third[0] == third[2] + "," and third[0] != third[1] + ","
    assert occurrences([("t", df.limit(0), "id", "body")]).count() == 0
