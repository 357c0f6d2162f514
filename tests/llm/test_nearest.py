"""Nearest pairing against brute force, ties and bounds."""

import random

import pytest

from changeprism.llm.nearest import nearest


def brute(left, right, tolerance):
    out = []
    for e, i, a in left:
        near = [(abs(a - b), n, a - b) for f, n, b in right if e == f and e is not None and a is not None and b is not None and abs(a - b) < tolerance]
        if near:
            d, n, delta = min(near)
            out.append((e, i, n, d))
    return sorted(out)


@pytest.mark.parametrize(("span", "tolerance", "band"), [(60, 10, 20), (2000, 50, 130), (-40, 7, 14)])
def test_equals_brute_force(spark, span, tolerance, band):
    rng = random.Random(span)
    at = lambda: rng.choice([None] + [rng.randrange(min(0, span), max(1, span)) for _ in range(9)])
    left = [(rng.choice([1, 1, 2, None]), i, at()) for i in range(250)]
    right = [(rng.choice([1, 1, 2, 3]), rng.randrange(500), at()) for _ in range(120)]
    got = nearest(spark.createDataFrame(left, "entity long, id int, at long"), spark.createDataFrame(right, "entity long, number int, at long"), tolerance, band)
    assert sorted((r.entity, r.id, r.number, abs(r.distance)) for r in got.collect()) == brute(left, right, tolerance)


def test_empty_and_too_narrow_bands(spark):
    left, right = spark.createDataFrame([(1, 1, 5)], "entity long, id int, at long"), spark.createDataFrame([], "entity long, number int, at long")
    assert nearest(left, right, 5, 10).count() == 0
    with pytest.raises(ValueError, match="twice"):
        nearest(left, right, 5, 9)
