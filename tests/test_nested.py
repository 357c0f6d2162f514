"""Nested records against a plain recursive walk, and the defined results of the corner cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from changeprism.operators import nested
from changeprism.operators.nested import NestedIndex, StructuralIndex, flatten_objects


def plain(value):
    """``value`` with strings of JSON read through."""
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            return value
        return plain(inner) if isinstance(inner, (dict, list, str)) else value
    if isinstance(value, list):
        return [plain(x) for x in value]
    return {k: plain(x) for k, x in value.items()} if isinstance(value, dict) else value


def walk(value, path, above, keys, out):
    for i, x in enumerate(value) if isinstance(value, list) else ():
        node = f"{path}[{i}]"
        if isinstance(x, dict):
            out.append((above, node))
        walk(x, node, node if isinstance(x, dict) else above, keys, out)
    for k, x in value.items() if isinstance(value, dict) else ():
        node = f"{path}.{k}" if path else k
        if isinstance(x, dict) and k in keys:
            out.append((above, node + "[0]"))
            walk(x, node + "[0]", node + "[0]", keys, out)
        else:
            walk(x, node, above, keys, out)


def array_keys(value, keys):
    for k, x in value.items() if isinstance(value, dict) else ((None, x) for x in value) if isinstance(value, list) else ():
        if k is not None and isinstance(x, list) and any(isinstance(y, dict) for y in x):
            keys.add(k)
        array_keys(x, keys)


def brute(texts):
    values, keys = {}, set()
    for i, t in texts:
        try:
            values[i] = plain(json.loads(t))
        except (ValueError, TypeError):
            continue
        array_keys(values[i], keys)
    rows = []
    for i, v in values.items():
        out = []
        walk(v, "", "", keys, out)
        rows += [(i, p, n) for p, n in out]
    return sorted(rows)


def made(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.25:
        return rng.choice([None, 1, -2.5, True, "", 'a"b\\', "{[,:]}", "\\\\\"", "ü\n☃", "x,y"])
    if kind < 0.6:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind < 0.65:
        return json.dumps(made(rng, depth + 1))
    return {rng.choice(["a", "b", "k y", 'q"t', "ключ", "files"]): made(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_random_values_equal_the_recursive_walk(spark):
    rng = random.Random(7)
    texts = [(i, json.dumps(made(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))) for i in range(400)]
    texts += [(900, None), (901, ""), (902, "  "), (903, '{"a":[{'), (904, "[1,2"), (905, '"x'), (906, "null"), (907, "7")]
    df = spark.createDataFrame(texts, "id long, v string").repartition(3).withColumn("record_id", F.lit("clash"))
    got = flatten_objects([("t", "v", df, "id")]).select("record_id", "parent_path", "node_path").collect()
    assert sorted(map(tuple, got)) == brute(texts)


def test_whole_table_equals_the_recursive_walk(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/github_commits.parquet").select("id", "raw_data")
    got = flatten_objects([("t", "raw_data", df, "id")]).select("record_id", "parent_path", "node_path").collect()
    assert sorted(map(tuple, got)) == brute([tuple(r) for r in df.collect()])


def rows_of(texts, keys=()):
    return list(NestedIndex([t.encode() for t in texts]).nodes(lambda _, k: k in keys))


def test_long_text_and_deep_text():
    long = json.dumps({"a": [{"x": "y" * 3_000_000}, {"b": [{}] * 1000}]})
    nodes = rows_of([long, '{"c":{"a":{"z":[]}}}'], {"a"})
    assert len(nodes) == 1003 and (1, "", "c.a[0]") in nodes
    deep = "[" * 200_000 + "]" * 200_000
    assert rows_of([deep, deep[:-1], "[{}]"]) == [(2, "", "[0]")]


def test_strings_in_strings_at_any_level():
    text, levels = '{"a":[{"b":1}]}', 14
    for _ in range(levels):
        text = json.dumps(text)
    assert rows_of([text]) == [(0, "", "a[0]")]
    assert rows_of([json.dumps({"s": [json.dumps(json.dumps({"x": {"y": 1}})), "{bad"]})], {"x"}) == [(0, "", "s[0]"), (0, "s[0]", "s[0].x[0]")]
    assert set(NestedIndex([json.dumps({"k": json.dumps([1, {}]), "m": [json.dumps({})], "n": json.dumps({"o": [[{}]]})}).encode()]).keys_of_object_arrays()) == {(0, "k"), (0, "m")}


def test_complete_json_is_what_a_parser_takes():
    good = ["{}", "[]", " [1, -0.5e+3 ,true,null, \"\\u00e9\\n\" ] ", '{"a":{"b":[]},"":0}', "[[],[]]", '"x"', "1"]
    wrong = ["", "{", "}", "[1,]", "[,1]", "{\"a\"}", '{"a":}', '{"a":1,}', "{1:2}", "[1 2]", "[1]]", "[}", "{]", "[01]", "[1.]", "[+1]", "[.5]", "[tru]", "[true1]", '["\\x"]', '["\\u12g4"]', '["\\u12"]', '["a\nb"]', '["a]', "[] []", "[]x", "{}{}", '{"a" 1}', '{"a"::1}', "[1:2]", ":", ",", "[\\]", "['a']", '{"a":1 "b":2}', "\x0b[]", '["a" "b"]', '{"a","b"}', "[{}{}]"]
    rng = random.Random(3)
    for t in good + [json.dumps({"a": [1, {"b": None}], "c": "d"})]:  # every text with one character less, more or other
        for _ in range(60):
            i = rng.randrange(len(t) + 1)
            wrong.append(rng.choice([t[:i] + t[i + 1 :], t[:i] + rng.choice('{}[],:"\\1 a') + t[i:], t[:i] + rng.choice('{}[],:"\\1 a') + t[i + 1 :]]))

    def parses(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    texts = good + wrong
    rng.shuffle(texts)
    assert StructuralIndex([t.encode() for t in texts]).valid.tolist() == [parses(t) for t in texts]


def test_more_keys_than_are_sent(spark, monkeypatch):
    rng = random.Random(9)
    texts = [(i, json.dumps(made(rng))) for i in range(120)]
    df = spark.createDataFrame(texts + texts[:3], "id long, v string").repartition(3)
    monkeypatch.setattr(nested, "MAX_ARRAY_KEYS", 1)
    got = flatten_objects([("t", "v", df, "id")]).select("record_id", "parent_path", "node_path").collect()
    again = [r for r in brute(texts) if r[0] < 3]
    assert sorted(map(tuple, got)) == sorted(brute(texts) + again)


@pytest.mark.parametrize("texts", [[], [(1, None)], [(1, "{}"), (1, "{}")]])
def test_empty_inputs(spark, texts):
    assert flatten_objects([("t", "v", spark.createDataFrame(texts, "id long, v string"), "id")]).count() == 0
