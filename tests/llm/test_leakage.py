"""Leaks made from passages are found in any writing, short quotes and other texts are not."""

import random

from changeprism.llm import leakage
from changeprism.llm.leakage import MIN_WORDS, Leaks, WuManber, leaked_items, words

POOL = [f"{a}{b}" for a in "ba ke lo mi nu ra so ti vu za".split() for b in "lder mpor nstic rrand ssel ttern vane xil".split()]


def passage(rng, n=50):
    return [rng.choice(POOL) for _ in range(n)]


def test_search_equals_brute_force():
    rng = random.Random(2)
    few = POOL[:6]
    ps = {k: [rng.choice(few) for _ in range(8)] for k in range(5)}
    text = [rng.choice(few) for _ in range(400)]
    want = {k: [i for i in range(len(text) - 2) if any(text[i : i + 3] == p[j : j + 3] for j in range(len(p) - 2))] for k, p in ps.items()}
    got = WuManber(ps).search(text)
    assert {k: v for k, v in want.items() if v} == {k: sorted({i for i, _ in v}) for k, v in got.items()}
    assert all(text[i : i + 3] == ps[k][j : j + 3] for k, v in got.items() for i, j in v)


def test_writings_edits_and_length():
    rng = random.Random(5)
    items = [(k, " ".join(passage(rng)).capitalize() + ".") for k in range(20)]
    leaks = Leaks(items)
    for k, p in items:
        w = words(p)
        assert leaks.of("x " + p + " y") == [(k, 50)]
        assert leaks.of("intro " + " ".join(w[5 : 5 + MIN_WORDS]) + " outro")[0][0] == k
        assert leaks.of("intro " + " ".join(w[5 : 4 + MIN_WORDS]) + " outro") == []
        odd = "\n> ".join(f"**{x.upper()}**" if i % 3 else x.replace("a", "а") for i, x in enumerate(w)).replace("o", "o­")
        assert leaks.of(odd) == [(k, 50)], odd
        wide = "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in p)
        assert leaks.of(wide) == [(k, 50)]
        edited = [y for i, x in enumerate(w) for y in ([] if i % 9 == 4 else ["other"] if i % 9 == 7 else [x, "just"] if i % 11 == 2 else [x])]
        assert leaks.of(" ".join(edited))[0][0] == k
        broken = p.replace("s", "s-\n# ", 3)
        assert leaks.of(broken)[0][0] == k
    assert leaks.of(" ".join(passage(rng, 3000))) == []


def test_insertions_of_any_length_and_long_tags():
    rng = random.Random(6)
    items = [(k, " ".join(passage(rng))) for k in range(10)]
    leaks, other = Leaks(items), passage(rng, 400)
    for k, p in items:
        w = p.split()
        for n in (12, 60, 300):  # two parts of nine words with other words between, and three of seven
            assert leaks.of(" ".join(w[3:12] + other[:n] + w[12:21]))[0][0] == k
            assert leaks.of(" ".join(w[3:10] + other[:n] + w[10:17] + other[n : 2 * n] + w[20:27]))[0][0] == k
            assert leaks.of(" ".join(w[12:21] + other[:n] + w[3:12])) == []  # not in their order
        assert leaks.of(" ".join(w[3:10]) + '<a href="' + "x" * 500 + '">' + " " + " ".join(w[10:18]) + "</a>") == [(k, 15)]


def test_repeated_and_null_item_ids():
    rng = random.Random(7)
    p, q = " ".join(passage(rng)), " ".join(passage(rng))
    leaks = Leaks([(1, p), (1, q), (None, p)])
    assert sorted(leaks.of(q), key=str) == [(1, 50)] and sorted(leaks.of(p), key=str) == [(1, 50), (None, 50)]


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(passage(rng))) for k in range(9)]
    docs = [(k, f"intro {p} outro") for k, p in items]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    monkeypatch.setattr(leakage, "ITEMS_AT_ONCE", 4)
    assert sorted((r.doc_id, r.item_id) for r in leaked_items(d, i).collect()) == [(k, k) for k in range(9)]


def test_rows(spark):
    rng = random.Random(9)
    p, q = " ".join(passage(rng)), " ".join(passage(rng))
    items = spark.createDataFrame([(1, p), (2, q), (3, None), (4, ""), (5, "few words")], "item_id long, passage string")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, f"{q} {p}", 0), (3, f"{q} {p}", 0), (4, "z " * 100_000 + p, 0), (5, "few words", 0)], "doc_id long, text string, item_id int")
    got = sorted((r.doc_id, r.item_id) for r in leaked_items(docs, items).collect())
    assert got == [(3, 1), (3, 1), (3, 2), (3, 2), (4, 1)]
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0
