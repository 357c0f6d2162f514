"""Diffs in chunks against plain loops, reports, sinks and the small rules of texts and links with known results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from changeprism.functions import diff, text
from changeprism.operators import extractors, graph, linking, quality, report, review, units
from changeprism.operators.tools import call
from changeprism.sources import sinks


def test_chunks_of_hunks_equal_a_loop(spark):
    rng = random.Random(1)

    def plain(patch, most):
        parts, out = [p for p in ("\n" + patch).split("\n@@ ") if p.strip("\n")], []
        parts = [p if patch.startswith(p) and not i else "@@ " + p for i, p in enumerate(p.lstrip("\n") for p in parts)]
        parts = [p if p.startswith("@@ ") or i == 0 and not patch.startswith("@@ ") else "@@ " + p for i, p in enumerate(parts)]
        for p in parts:
            if out and len(out[-1]) <= most:
                out[-1] += "\n" + p
            else:
                out.append(p)
        return out

    patches = ["", "no hunk", *("\n".join(f"@@ -{i} +{i} @@\n" + "\n".join("+" + "x" * rng.randrange(9) for _ in range(rng.randrange(1, 5))) for i in range(rng.randrange(1, 7))) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(patches)), "i int, p string")
    got = {r.i: r.c for r in df.select("i", diff.hunk_chunks(F.col("p"), 30).alias("c")).collect()}
    for i, p in enumerate(patches):
        assert got[i] == (plain(p, 30) if p else []), (p, got[i])
        assert "\n".join(got[i]) == p


def test_chunks_of_functions(spark):
    body = "import os\n\ndef a():\n    pass\n\nasync def b():\n    return 1\nclass C:\n    def m(self):\n        pass"
    rows = [(1, body, "python"), (2, "\n".join("x" * 3 for _ in range(7)), "text"), (3, "", "python"), (4, None, None), (5, "func A() {\n}\nfunc B() {\n}", "go")]
    df = spark.createDataFrame(rows, "i int, c string, l string")
    got = {r.i: [tuple(x) for x in r.f] for r in df.select("i", diff.function_chunks(F.col("c"), F.col("l"), 25, 3).alias("f")).collect()}
    assert got[1] == [(0, 5), (5, 2), (7, 3)] and got[2] == [(0, 3), (3, 3), (6, 1)] and got[3] == [(0, 1)] and got[4] == [(0, 1)] and got[5] == [(0, 4)]
    for i, c, _ in rows[:2]:  # every line once, in order
        assert [k for a, n in got[i] for k in range(a, a + n)] == list(range(len(c.split("\n"))))
    assert len(df.where("i = 2").select(diff.function_chunks(F.col("c"), F.col("l"), 25, 1, 2).alias("f")).first().f) == 2


def test_extraction_of_commits(spark):
    new, old = "@@ -0,0 +1,3 @@\n+def a():\n+    pass\n+x = 1", "\n".join(f"@@ -{i} +{i} @@\n+{'y' * 60_000}" for i in range(30))
    rows = [(1, "s", "a.py", "added", new), (1, "s", "b.py", "modified", old), (1, "s", "c.md", "modified", new), (1, "s", "d.py", "removed", new), (1, "s", "e.py", None, None)]
    out = diff.extracted_chunks(spark.createDataFrame(rows, "repo_id int, sha string, filename string, status string, patch string"), 4).collect()
    got = {}
    for r in out:
        got.setdefault(r.filename, []).append((r.kind, r.number, r.batch, r.skipped))
    assert got["a.py"] == [("function", 0, 0, 0)] and [x[1] for x in got["b.py"]] == [0, 1, 2, 3] and got["b.py"][0][3] == 11 and set(got) == {"a.py", "b.py"}
    assert next(r.content for r in out if r.filename == "a.py") == "def a():\n    pass\nx = 1"


def test_lines_ranges_and_paths(spark):
    d = "@@ -1,3 +10,4 @@ f\n a\n+b\n-c\n+d\n\\ No newline at end of file\n e\n@@ -9 +30 @@\n+z"
    r = spark.createDataFrame([(d, "y.py", ["src/y.py", "x/y.py"]), (None, "/x.py", ["x.py"]), ("", "q.py", ["a.py"])], "d string, p string, ps array<string>")
    got = r.select(diff.changed_lines(F.col("d")).alias("l"), diff.line_range(diff.hunks(F.col("d"))).alias("r"), diff.matching_path(F.col("p"), F.col("ps")).alias("m"), diff.line_delta(F.lit("a\nb\nc"), F.col("d")).alias("x")).collect()
    assert [(x.l, tuple(x.r), x.m, tuple(x.x)) for x in got] == [([11, 12, 30], (10, 30), "src/y.py", (6, 0)), ([], (0, 0), "x.py", (0, 3)), ([], (0, 0), None, (0, 3))]
    c = spark.createDataFrame([(1, 5), (1, 6), (1, 90)], "key int, line int")
    k = spark.createDataFrame([(1, "a", 1, 1, 5), (1, "b", 2, 5, 6), (1, "c", 3, 5, 6), (2, "d", 1, 1, 2), (2, "e", 2, 1, 2)], "key int, candidate string, position int, start_line int, end_line int")
    assert {(x.key, x.candidate, round(x.confidence, 3)) for x in units.by_overlap(c, k).collect()} == {(1, "b", 0.667), (2, "d", 0.5)}


def test_small_rules_of_texts(spark):
    one = spark.range(1)
    t = one.select(
        text.snippet(F.lit("x" * 60 + "#7" + "y" * 60), F.lit("#7")).alias("s"), text.shortened(F.lit("a" * 2001)).alias("c"), text.file_paths(F.lit("see (src/a.py), src/a.py; b.go and README.md")).alias("f"),
        text.repository_of(F.lit("git@h.example:o/n.git")).alias("u"), text.repository_of(F.lit("nothing")).alias("v"), text.test_names(F.lit("src/a.py")).alias("n"), text.dense_lines(F.array(F.lit("# comment here"), F.lit("+f(x) = {a.b}"), F.lit("plain words in a row")), F.lit(8)).alias("d"),
        text.plain_similarity(F.lit("The Parser, hangs!"), F.lit("parser hangs often")).alias("p"), text.issue_similarity(F.lit("Fix parser"), F.lit(None).cast("string"), F.lit("parser fix"), F.lit("long body text")).alias("i"), text.file_kind(F.lit("pkg/config_test.go")).alias("k"),
        text.suggested_files(F.lit("a.py broke a.py and b.go"), F.lit("c.rs")).alias("g"),
    ).first()
    assert t.s == "..." + "x" * 50 + "#7" + "y" * 50 + "..." and len(t.c) == 1000 + 17 + 500 and t.f == ["src/a.py", "b.go"] and tuple(t.u) == ("o", "n") and t.v is None
    assert t.n == ["src/test_a.py", "src/a_test.py", "src/tests/test_a.py"] and t.d == ["+f(x) = {a.b}", "plain words in a row"] and round(t.p, 3) == 0.667 and t.i == 1.0 and t.k == "test"
    assert [(x.path, x.confidence) for x in t.g] == [("a.py", 0.9), ("b.go", 0.6), ("c.rs", 0.8)]


def test_acceptance_and_boosts(spark):
    h = 3_600_000_000
    rows = [(60_000_000, 0.0), (2 * h, 0.05), (2 * h, 0.10), (-2 * h, 0.25), (24 * h, 0.9), (h - 1, 0.0)]
    got = spark.createDataFrame(rows, "d long, s double").select(linking.accepted(F.col("d"), F.col("s")).alias("a")).collect()
    assert [x.a and (round(x.a.confidence, 2), x.a.evidence) for x in got] == [(0.75, ["temporal_match_5min"]), None, (0.60, ["temporal_match_24hr", "semantic_boost"]), (0.65, ["temporal_match_24hr", "semantic_boost"]), None, (0.65, ["temporal_match_1hr"])]
    c = spark.createDataFrame([("Fixes PR 5", 5), ("nothing", 5), ("Merge pull request #5", 5), (None, 5)], "m string, n int").select(linking.checked_reference(F.col("m"), F.col("n"), F.lit(0.8)).alias("a"), linking.checked_reference(F.col("m"), F.col("n"), F.lit(0.5)).alias("b")).collect()
    assert [(x.a and round(x.a, 2), x.b and round(x.b, 2)) for x in c] == [(0.8, 0.5), (0.24, None), (None, None), (0.24, None)]
    r = spark.createDataFrame([("ann", False), ("bob", False), ("ci", True), ("eve", False)], "w string, b boolean").select(linking.commenter_role(F.col("w"), F.lit("ann"), F.array(F.lit("bob")), F.col("b")).alias("r"))
    assert [(x.r, round(x.c, 2)) for x in r.select("r", linking.role_boosted(F.lit(0.9), F.col("r")).alias("c")).collect()] == [("owner", 0.98), ("collaborator", 0.98), ("bot", 0.95), ("contributor", 0.93)]
    t = spark.createDataFrame([("github_timeline_verified", 0.9, 0.0, 0.12, 0.0, 0.0, []), ("explicit_bidirectional", 0.9, 0.0, 0.0, 0.0, 0.1, ["x_ref_fixes"]), ("explicit_bidirectional", 0.9, -0.1, 0.2, 0.1, 0.0, []), ("explicit", 0.9, 0.0, 0.2, 0.1, 0.0, []), ("explicit_bidirectional", 0.84, 0.0, 0.2, 0.1, 0.0, None), ("explicit_bidirectional", 0.9, None, None, None, 0.1, None)], "m string, b double, p double, t double, d double, s double, g array<string>")
    assert [x[0] for x in t.select(graph.link_type(*(F.col(c) for c in "mbptdsg"))).collect()] == ["FIXED_BY", "FIXED_BY", "ASSOCIATED_WITH", "ASSOCIATED_WITH", "ASSOCIATED_WITH", "ASSOCIATED_WITH"]
    i = spark.createDataFrame([(1, "bug, wontfix", None), (2, None, "A duplicate. Won't fix"), (3, None, None)], "id int, labels string, comment string")
    assert {x.id: x.classification for x in extractors.classify_closures(i).collect()} == {1: "wontfix", 2: "duplicate", 3: "fixed_with_code"}


def test_quality_needs_ten_closed_issues_and_one_eligible(spark):
    at = dt.datetime(2024, 1, 1)
    issues = spark.createDataFrame([(r, n, "closed", at) for r, k in ((1, 10), (2, 9), (3, 10)) for n in range(k)] + [(1, 99, "open", None)], "repo_id int, number int, state string, closed_at timestamp")
    links = spark.createDataFrame([(1, 0, 0.9, ["explicit", "semantic_title", "semantic_body"], -60.0, True, 0.8, None, 0.9), (1, 1, 0.4, None, None, False, None, None, None)], "repo_id int, issue_number int, confidence double, evidence array<string>, delta_seconds double, analysed boolean, title_score double, body_score double, comment_score double")
    none = spark.createDataFrame([(3, n, "duplicate") for n in range(10)] + [(1, 9, "wontfix"), (1, 8, "fixed")], "repo_id int, number int, classification string")
    q = quality.link_quality(issues, links, none).collect()
    assert [(r.repo_id, r.total_closed, r.eligible, r.linked, r.unlinked) for r in q] == [(1, 10, 9, 1, 8)]
    r = q[0]
    assert (round(r.coverage, 3), round(r.diversity, 3), r.precision, round(r.strength, 6), round(r.confidence, 3)) == (11.111, round(100 * 1 / 6, 3), 100.0, 90.0, round(100 * (0.9 + 0.4 * 0.3) / 1.3, 3))
    assert (r.grade, r.rank, r.multiplier, r.precision_status, r.coverage_status) == ("F", "Poor Quality", 0.25, "Excellent", "Poor")
    a = quality.advice(quality.link_quality(issues, links, none)).first()
    assert [(x.priority, x.category, x.impact) for x in a.advice] == [(1, "coverage", "high"), (2, "confidence", "high"), (3, "diversity", "low"), (4, "diversity", "low"), (5, "overall", "high")] and round(a.gain, 2) == 0.05


def test_report_takes_all_its_arguments(spark):
    u = spark.createDataFrame([(1, 1, "f", "a.py", "function", 10), (1, 2, "g", "a.py", "class", 100), (1, 3, "h", "b.py", "function", 400), (2, 1, "f", "a.py", "function", None)], "repo_id int, block int, name string, file string, kind string, staleness_days int")
    p = spark.createDataFrame([(1, 1, 2, 0.9), (1, 1, 3, 0.6), (1, 2, 3, 0.2)], "repo_id int, a int, b int, rate double")
    i = spark.createDataFrame([(1, 1, k, dt.datetime(2024, 1, 1 + k)) for k in range(12)] + [(1, 3, 50, dt.datetime(2024, 1, 1))], "repo_id int, block int, issue int, at timestamp")
    run = lambda **k: report.risk_report(u, p, i, include_score=True, **k).collect()
    r = run(max_coupled=2, max_incidents=3)
    assert [(x.repo_id, x.block, x.incident_count) for x in r] == [(1, 1, 10), (1, 3, 1), (1, 2, 0), (2, 1, 0)]
    assert round(r[0].risk_score, 2) == round(100 + 2 * 1.5 + 10 / 30, 2) and [c.other for c in r[0].coupled] == [2, 3] and [c.issue for c in r[0].incidents] == [11, 10, 9]
    assert [x.block for x in run(repo_id=1, paths=["a.py"], kinds=["class"])] == [2] and [x.block for x in run(names=["h"])] == [3] and len(run(max_blocks=1)) == 1 and [x.block for x in run(min_staleness=100, max_blocks=0)] == [3, 2]
    assert [x.block for x in run(min_incidents=1, min_score=50.0)] == [1] and run(prioritize_recent=True)[0].risk_score > r[0].risk_score
    assert "risk_score" not in report.risk_report(u, p, i).columns
    s = report.report_summary(u, report.risk_report(u, p, i, min_incidents=1, max_blocks=0)).first()
    assert (s.total_blocks, s.matching_blocks, s.block_kinds, s.total_incidents, s.max_staleness) == (4, 2, 1, 11, 400)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "repo_id int, v string")
    for form in ("parquet", "json", "csv"):
        sinks.write(df, str(tmp_path / form), form)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2 and spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.replace_repositories(df, str(tmp_path / "t"))
    sinks.replace_repositories(spark.createDataFrame([(2, "x"), (3, "y")], "repo_id int, v string"), str(tmp_path / "t"))
    assert {(r.repo_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "x"), (3, "y")}
    sinks.append(df, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 4
    assert sinks.document(df, "1.0", "repo_id").orderBy("repo_id").collect()[1].doc == '{"version":"1.0","data":{"repo_id":2,"v":null}}'
    h = spark.createDataFrame([(1, "h1"), (2, "h2")], "repo_id int, hash string")
    assert [r.repo_id for r in report.invalidated(df, h, h.withColumn("hash", F.when(F.col("repo_id") == 2, "h3").otherwise(F.col("hash")))).collect()] == [1]


def test_tools(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert {(r.file, r.dependents) for r in call("blast_radius", e, 2, 5).collect()} == {("b", 1), ("c", 2)}
    with pytest.raises(KeyError, match="risk_report"):
        call("nothing")


def test_search_levels(spark):
    d = spark.createDataFrame([(1, "bug bug bug bug bug"), (2, "bug"), (3, "bug bug"), (4, None)], "id int, t string")
    assert [(r.id, r.level) for r in review.search(d, "id", [("t", 1.0)], "Bug").collect()] == [(1, "high"), (3, "medium"), (2, "low")]
