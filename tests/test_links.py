"""Links of issues and pull requests by time and text: one busy repository, odd texts, what is done for each pair."""

import re

import __spark_entry__ as entry
import pytest
from compare import differs, duck
from pyspark.sql import functions as F

from changeprism.functions import text

TEXTS = [
    None, "", "the of 42", "Fix parser", "parser fixes https://", "x**y and __init__", "crash*", "*crashes*", "see https://a.b/c#d now", "snake_case-word words", "Ünïcode café ΣΑΣ", "0a a0 00a", "averyveryverylongwordindeed averyveryverylongwordinded", "parsing\tfast\nfaster ```code```",
]


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """All records in one repository and three days, with odd texts."""
    d, of = str(tmp_path_factory.mktemp("busy")), "/root/testdata/sf0.001"
    spark.read.parquet(f"{of}/github_commits.parquet").write.parquet(f"{d}/github_commits.parquet")
    texts = F.array(*[F.lit(t).cast("string") for t in TEXTS])
    for name, at in (("github_issues", "closed_at"), ("github_pull_requests", "merged_at")):
        t = spark.read.parquet(f"{of}/{name}.parquet").withColumn("repo_id", F.when(F.col("id") % 17 != 0, F.lit(1)).cast("bigint"))
        when = F.when(F.col("id") % 13 != 0, F.timestamp_micros(F.lit(1_600_000_000_000_000) + F.pmod(F.hash("id", F.lit(name)), F.lit(3 * 86_400)).cast("bigint") * 1_000_000).cast("timestamp_ntz"))
        odd = lambda salt: texts[F.pmod(F.hash("id", F.lit(salt)), F.lit(len(TEXTS)))]
        t.withColumns({at: when, "title": odd("title" + name), "body": odd("body" + name)}).write.parquet(f"{d}/{name}.parquet")
    return d


def test_similarity_of_pairs_equals_sql(spark, busy):
    want = duck(busy, entry.oracle_sql()["text_issue_pull_similarity"])
    assert len(want) > 300 and (want.similarity > 0).sum() > 30
    assert not differs(entry.queries()["text_issue_pull_similarity"](spark, busy), want)


def test_texts_are_read_before_the_pairs_are_made(spark, busy):
    plan = entry.queries()["text_issue_pull_similarity"](spark, busy)._jdf.queryExecution().optimizedPlan().toString()
    above, join, below = re.split(r"(\bJoin Inner.*)", plan, maxsplit=1)[:3]
    assert "regexp" not in above + join and "regexp" in below


def test_packed_words_stay_apart(spark):
    words = ["a", "0a", "00a", "a0", "1", "10", "z" * 11, "z" * 12, "1" + "z" * 11, "0" * 11, "0" * 12, "a-b", "a_b", "ab"]
    rows = [(words[i:], words[: i + 3] + words[i % 5 :: 3]) for i in range(len(words))]
    t = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", F.array_distinct("b").alias("b"))
    a, b = text.packed(F.col("a")), text.packed(F.col("b"))
    for r in t.select("a", "b", text.packed_common(a, b).alias("n"), text.packed_size(text.packed_union(a, b)).alias("m"), a["codes"].alias("codes")).collect():
        assert (r.n, r.m) == (len(set(r.a) & set(r.b)), len(set(r.a) | set(r.b))) and len(set(r.codes)) == len(r.codes) and None not in r.codes


def test_accepted_pairs_equal_sql(spark, busy):
    want = duck(busy, entry.oracle_sql()["link_accepted"])
    assert want.evidence.nunique() > 4 and len(want) < len(duck(busy, entry.oracle_sql()["text_issue_pull_similarity"]))
    assert not differs(entry.queries()["link_accepted"](spark, busy), want)


def test_accepted_pairs_are_compared_once(spark, busy):
    """Neither the join's condition nor a filter makes the similarity again."""
    plan = entry.queries()["link_accepted"](spark, busy)._jdf.queryExecution().optimizedPlan().toString()
    above, join = re.split(r"(\bJoin Inner.*)", plan, maxsplit=1)[:2]
    assert "regexp" not in above + join and "array_intersect" not in join
    assert sum("array_intersect" in line for line in above.splitlines()) == 1
