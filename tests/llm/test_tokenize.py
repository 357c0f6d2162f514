"""The automaton against the public library, an explicit construction and round trips."""

import random
from pathlib import Path

import numpy as np
import pytest

from changeprism.llm.tokenize import VOCABULARY, Automaton, decode, encode, explicit_table

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def automaton():
    return Automaton(Path(VOCABULARY).read_bytes())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_random_and_odd_texts_equal_the_library(automaton, library):
    rng = random.Random(3)
    texts = ["", " ", "\n\n  x", "<|endoftext|>", "'s 't're", "a" * 5000, "-" * 700, "héé́ ﷽　\x1c\x85", "don't we'll  \t\r\n end   "]
    alphabet = "aaaabcdehtino  ,.-_=\n\t01279éüßñł日本語🙂  '\"{}()ABC"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(1500)]
    texts += ["".join(rng.choice(automaton.labels[256:])[:9].decode("utf-8", "ignore") for _ in range(40)) for _ in range(300)]
    for text in texts:
        ids = automaton.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert automaton.decode(ids) == text


def test_arcs_equal_the_explicit_construction():
    import json

    from changeprism.llm.tokenize import _letters

    letters = {b: c for c, b in _letters().items()}
    rng = random.Random(5)
    names = [letters[b] for b in range(256)]
    merges: list[tuple[int, int]] = []
    pool = [97, 98, 99]
    while len(merges) < 60:
        pair = (rng.choice(pool), rng.choice(pool))
        if pair in merges or names[pair[0]] + names[pair[1]] in names:
            continue
        table = explicit_table([*merges, pair])
        if not explicit_table(merges)[pair]:
            continue
        assert table.shape[0] == 256 + len(merges) + 1
        merges.append(pair)
        names.append(names[pair[0]] + names[pair[1]])
        pool.append(255 + len(merges))
    model = {"model": {"vocab": {n: i for i, n in enumerate(names)}, "merges": [[names[a], names[b]] for a, b in merges]}}
    automaton = Automaton(json.dumps(model).encode())
    table = explicit_table(merges)
    lazy = np.array([[automaton.arc(s, t) for t in pool] for s in pool])
    assert (lazy == table[np.ix_(pool, pool)]).all()


def test_documents_equal_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.ids for r in encode(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}
    back = {r.doc_id: r.text for r in decode(encode(docs)).collect()}
    assert back == {k: t or "" for k, t in texts.items()}


def test_null_empty_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, " ", 7), (3, "a b", 8), (3, "a b", 8)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encode(df).collect()) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert encode(df.limit(0)).count() == 0
