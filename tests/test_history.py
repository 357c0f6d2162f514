"""Small cases with known results for the change-history operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from changeprism.functions import diff, text
from changeprism.operators import coupling, incidents, linking, ownership, review, risk, summary, tables
from changeprism.sources import gitlog
from changeprism.streaming import events as streams

T = dt.datetime
AS_OF = "2024-01-31 00:00:00"


def at(day):
    return T(2024, 1, day)


def now():
    return F.lit(AS_OF).cast("timestamp")


@pytest.fixture(scope="module")
def changes(spark):
    of = {"A": "1234", "B": "123", "C": "34"}
    return spark.createDataFrame([(f"c{k}", b, "dev", at(int(k))) for b, ks in of.items() for k in ks], "sha string, block string, author string, at timestamp")


def test_cochange(changes):
    got = {(r.a, r.b): (r.n, round(r.rate, 4)) for r in coupling.cochange_pairs(changes, now(), min_count=1, min_rate=0).collect()}
    assert got == {("A", "B"): (3, 0.75), ("A", "C"): (2, 0.5), ("B", "C"): (1, 0.3333)}
    assert coupling.cochange_pairs(changes, now()).count() == 0
    twice = changes.unionByName(changes.where("sha = 'c1' AND block = 'A'"))
    again = {(r.a, r.b): (r.n, round(r.rate, 4)) for r in coupling.cochange_pairs(twice, now(), min_count=1, min_rate=0).collect()}
    assert again["A", "B"] == (3, 0.6)
    assert coupling.cochange_pairs(changes, now(), min_count=1, min_rate=0, incidents=changes.where("block != 'C'")).count() == 1
    pairs = coupling.cochange_pairs(changes, now(), min_count=1, min_rate=0)
    assert {r.block: r.couplings for r in coupling.coupling_aggregates(pairs).collect()} == {"A": 2, "B": 2, "C": 2}
    s = coupling.coupling_statistics(pairs).first()
    assert (s.total, s.high, s.medium) == (3, 1, 1)


def test_file_cochange(spark):
    rows = [("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c3", "a"), ("c3", "c"), ("c4", "b")]
    got = coupling.file_cochange(spark.createDataFrame(rows, "sha string, block string"), 0.5).collect()
    assert [(r.a, r.b, r.co_changes, round(r.frequency, 4)) for r in got] == [("a", "b", 2, 0.6667)]


def test_ownership(spark):
    rows = [("f", f"s{i}", who, at(i)) for i, who in enumerate(["alice", "alice", "bob", "bob", "bob"], 1)]
    c = spark.createDataFrame(rows, "block string, sha string, author string, at timestamp")
    r = ownership.transition(c).first()
    assert (r.first_author, r.second_author, r.transition_at) == ("bob", "alice", at(5))
    r = ownership.first_and_last_author(c, now()).first()
    assert (r.original_author, r.last_modifier, r.staleness_days) == ("alice", "bob", 26)
    assert [(r.author, r.edits) for r in ownership.familiarity(c).orderBy("rank").collect()] == [("bob", 3), ("alice", 2)]
    assert abs(sum(r.share for r in ownership.ownership_share(c).collect()) - 1) < 1e-9
    assert ownership.bus_factor(c).first().level == "MEDIUM"
    assert ownership.churn(c, now()).first().current_owner == "bob"


def test_incidents(spark):
    e = spark.createDataFrame([(1, "abc", at(2)), (1, "abd", at(1)), (2, "abc", at(3))], "issue int, sha string, at timestamp")
    c = spark.createDataFrame([("b1", "abc"), ("b1", "abd"), ("b2", "abc"), ("b3", "zzz")], "block string, sha string")
    links = incidents.link_incidents(e, c)
    assert {(r.block, r.issue): r.sha for r in links.collect()} == {("b1", 1): "abd", ("b1", 2): "abc", ("b2", 1): "abc", ("b2", 2): "abc"}
    assert {r.block: (r.incidents, r.last_at) for r in incidents.incident_counts(c, links.where("issue = 1")).collect()}["b3"] == (0, None)
    kinds = spark.createDataFrame([(["ui", "Bug"],), (["ui"],), ([],), (["P1", "security-x", "bug"],)], "l array<string>")
    assert [r[0] for r in kinds.select(incidents.incident_type(F.col("l"))).collect()] == ["bug", "ui", "unknown", "security"]


def test_risk(spark):
    rows = [("P", 5, at(21), 73, 2, 4, 0.5), ("Q", 2, T(2023, 10, 23), 0, None, 0, None), ("R", 0, None, 0, None, 0, None)]
    b = spark.createDataFrame(rows, "block string, incidents int, last_at timestamp, staleness_days int, complexity int, couplings int, avg_rate double")
    got = {r.block: round(r.risk_score, 6) for r in risk.composite_risk(b, now()).collect()}
    assert got == {"P": 100.0, "Q": 16.949153, "R": 0.0}
    one = spark.createDataFrame([(5, 7.2, 45, False), (0, 0.6, 365, False), (1, 10.5, 5, True), (0, 0.0, 10, False)], "i int, r double, s int, c boolean")
    assert [round(x[0], 2) for x in one.select(risk.ranked_risk(F.col("i"), F.col("r"), F.col("s"), F.col("c"))).collect()] == [65.9, 4.2, 33.17, 0.33]


def test_linking(spark):
    x = spark.createDataFrame([(0.95, 0.10, 0.72, 200), (0.60, 0.0, 0.35, 90000), (0.60, 0.0, 0.10, -400000)], "b double, d double, s double, t long")
    us = F.col("t") * 1_000_000
    c = linking.final_confidence(F.col("b"), F.col("d"), linking.semantic_boost(F.col("s")), linking.temporal_boost(us), F.when(F.col("t") < 0, -0.15).otherwise(0.0))
    got = [(round(r.c, 2), r.q, r.p) for r in x.select(c.alias("c"), linking.quality(c).alias("q"), linking.temporal_pattern(us).alias("p")).collect()]
    assert got == [(0.98, "high", "simultaneous"), (0.70, "medium", "normal"), (0.45, "low", "reverse")]
    p = spark.createDataFrame([(1, at(1), at(1) + dt.timedelta(hours=h)) for h in (1, 2, 4, 10)] + [(2, at(1), None)], "repo int, created_at timestamp, merged_at timestamp")
    r = linking.lead_times(p, ["repo"]).collect()
    assert [(x.repo, x.n, x.median_hours, x.insufficient) for x in r] == [(1, 4, 3.0, True)]
    cases = spark.createDataFrame([(True, True)] * 7 + [(True, False)] * 2 + [(False, False)] * 2, "expected boolean, found boolean")
    m = linking.verdict_metrics(cases).first()
    assert (m.precision, round(m.recall, 3), round(m.f1, 3)) == (1.0, 0.778, 0.875)


def test_text_and_diff(spark):
    s = spark.createDataFrame([("( ctx context.Context , id int64 ): error",), ("(x:str,y:int)",), ("(flag: bool)",), ("()",), ("f(x):str",), ("[a:str]",), ("(a:bool)->x:bool",)], "s string")
    sig = text.signature(F.col("s"))
    assert [tuple(r) for r in s.select(sig, text.parameter_count(sig)).collect()] == [("(ctxcontext.Context,idint):error", 2), ("(x:string,y:int)", 2), ("(flag:boolean)", 1), ("()", 0), ("f(x):str", 1), ("[a:str]", 0), ("(a:boolean)->x:boolean", 1)]
    t = spark.createDataFrame([("Fixes #12 and closes #3, fixes #12", "1+bob@users.noreply.x.example")], "t string, e string")
    r = t.select(text.issue_references(F.col("t"), F.lit(None)).alias("r"), text.plain_email(F.col("e")).alias("e"), text.keywords(F.lit("The parser is Parsing **fast** 42 in https://x.y/z")).alias("k")).first()
    assert (r.r, r.e, r.k) == ([12, 3], "bob@users.noreply.x.example", ["fast", "parser", "pars", "parsing"][0:1] + ["pars", "parser", "parsing"])
    d = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -3 +3 @@\n-a\n+b\n@@ -9,2 +9,3 @@\n+c\ndiff --git a/y b/y\nnew file mode 100644\n@@ -0,0 +1 @@\n+z\ndiff --git a/o b/n\nrename from o\nrename to n"
    got = {r.path: (r.change_type, r.added, r.removed, [tuple(h) for h in r.hunks]) for r in diff.parse_diff(spark.createDataFrame([(1, d)], "id int, t string"), "id", "t").collect()}
    assert got == {"x.py": ("modified", 2, 1, [(3, 1, 3, 1), (9, 2, 9, 3)]), "y": ("added", 1, 0, [(0, 0, 1, 1)]), "n": ("renamed", 0, 0, [])}


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", 0.9, 1), (2, "b", 0.1, 5)], "k int, v string, c double, t int")
    new = spark.createDataFrame([(1, "x", 0.5, 2), (2, "y", 0.2, 3), (3, "z", 0.3, 1)], "k int, v string, c double, t int")
    assert {r.k: r.v for r in tables.upsert_last(old, new, ["k"], "t").collect()} == {1: "x", 2: "b", 3: "z"}
    assert {r.k: (r.c, r.v) for r in tables.upsert_greatest(old, new, ["k"], "c", "t").collect()} == {1: (0.9, "x"), 2: (0.2, "b"), 3: (0.3, "z")}
    assert sorted(r.v for r in tables.insert_absent(old, new, ["k"]).collect()) == ["a", "b", "z"]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src int, dst int")
    got = {(r.src, r.dst): r.hops for r in tables.reach(e, 3, e.where("src = 1")).collect()}
    assert got == {(1, 2): 1, (1, 3): 2, (1, 1): 3, (1, 4): 3}
    i = spark.createDataFrame([("c.py", ["a.py", "b.py"])], "canonical string, former array<string>")
    p = spark.createDataFrame([("a.py",), ("c.py",), ("x.py",)], "path string")
    assert {r.path: r.canonical for r in tables.canonical_paths(i, p).collect()} == {"a.py": "c.py", "c.py": "c.py", "x.py": "x.py"}


def test_events_of_one_unit_are_merged(spark):
    rows = [
        ("f", "b", "( x )", None, "CREATE_BLOCK", "o", "1", 1), ("f", "b", "(x)", None, "RENAME_BLOCK", "", "2", 2), ("f", "b", "(x)", None, "MODIFY_BLOCK", "p", "", 3), ("f", "b", "(y)", None, "MODIFY_BLOCK", "", "4", 4),
        ("f", None, None, "os", "ADD_IMPORT", "", "5", 5), ("f", None, None, "re", "ADD_IMPORT", "", "6", 6), ("g", "b", "", None, "MODIFY_BLOCK", "", "7", 7), ("g", "b", None, None, "MODIFY_BLOCK", "", "8", 8),
    ]
    e = spark.createDataFrame(rows, "target_file string, block_name string, signature string, dependency_path string, behavior string, old_version string, new_version string, seq int")
    got = {(r.target_file, r.new_version): (r.signature, r.behavior, r.old_version) for r in review.merge_events(e).collect()}
    assert got == {("f", f"1{review.BOUNDARY}2"): ("(x)", "RENAME_BLOCK", f"o{review.BOUNDARY}p"), ("f", "4"): ("(y)", "MODIFY_BLOCK", ""), ("f", "5"): (None, "ADD_IMPORT", ""), ("f", "6"): (None, "ADD_IMPORT", ""), ("g", f"7{review.BOUNDARY}8"): ("", "MODIFY_BLOCK", "")}


def test_events_are_checked(spark):
    rows = [("MODIFY_BLOCK", "f", "b", "method"), ("MODIFY_BLOCK", "f", "b", "macro"), ("MODIFY_BLOCK", "f", "b", "Variable"), ("MODIFY_BLOCK", "", "b", None), ("MODIFY_BLOCK", "f", " ", None), ("ADD_IMPORT", "f", None, None), ("MOVE", "f", "b", None), (None, "f", "b", None), ("RENAME_BLOCK", "f", "b", "")]
    e = spark.createDataFrame(rows, "behavior string, target_file string, block_name string, block_type string")
    assert [(r.reason, r.block_type) for r in review.checked_events(e).collect()] == [(None, "method"), (None, "function"), ("kind", "Variable"), ("file", None), ("name", None), (None, None), ("behavior", None), ("behavior", None), (None, "")]


def test_references_are_merged_in_order(spark):
    def fold(refs):
        c, m, act = refs[0][1], refs[0][0], refs[0][2]
        for method, conf, action in refs[1:]:
            c = max(c, conf)
            if method != m:
                m, c = "bidirectional", min(c + 0.05, 0.95)
            act = "fixes" if action == "fixes" else act
        return round(c, 6), m, act

    cases = {
        1: [("A", 0.6, "mentions"), ("B", 0.5, "fixes"), ("A", 0.4, "mentions")], 2: [("A", 0.6, "mentions"), ("A", 0.7, "mentions")], 3: [("A", 0.9, "fixes"), ("B", 0.98, "mentions")], 4: [("A", 0.1, "mentions")] + [("B", 0.1, "mentions")] * 40,
        5: [(None, 0.5, None), ("A", 0.5, None)],
    }
    rows = [(1, k, None, 7, m, c, a, i) for k, refs in cases.items() for i, (m, c, a) in enumerate(refs)] + [(1, 1, None, 8, "A", 0.2, "mentions", 0), (1, 1, "s", None, "A", 0.3, "mentions", 0), (2, 1, None, 7, "A", 0.2, "x", 0)]
    r = spark.createDataFrame(rows, "repo_id int, issue int, sha string, pr int, method string, confidence double, action string, seq int")
    got = {(x.repo_id, x.issue, x.sha, x.pr): (round(x.confidence, 6), x.method, x.action) for x in review.merge_references(r).collect()}
    want = {(1, k, None, 7): fold(v) for k, v in cases.items()} | {(1, 1, None, 8): (0.2, "A", "mentions"), (1, 1, "s", None): (0.3, "A", "mentions"), (2, 1, None, 7): (0.2, "A", "x")}
    assert got == want


def test_reference_types(spark):
    cases = (("This fixes #7", "fixes"), ("see #7", "mentions"), ("nothing", "mentions"), ("related to #7", "mentions"), ("implement #7", "mentions"), ("addresses #7", "addresses"), ("work for issue #7", "for"), ("fixes " + "x" * 100 + " #7", "mentions"), (None, "mentions"))
    t = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in t.orderBy("i").select(review.reference_type(F.col("t"), F.lit(7))).collect()] == [w for _, w in cases]


def test_git_log(spark, tmp_path):
    m, c, x, y = ("a" * 40, "b" * 40, "c" * 40, "d" * 40)
    log = f"{m}|Ann|a@x|2024-01-02T03:04:05|Merge|part\n{c}|Bob|b@x|bad|after a merge\n3\t1\ta.py\n-\t-\tb.png\n\n{x}|Cy|c@x|2024-01-03T00:00:00|blank line before the counts\n\n1\t0\tz z.py\n2\t2\tq.py\n{y}|Di|d@x|2024-01-04T00:00:00|last\n"
    (tmp_path / "log").write_text("0\t1\tlost.py\n" + log)
    want = {m: ("Merge|part", [], False), c: ("after a merge", ["a.py"], True), x: ("blank line before the counts", ["z z.py", "q.py"], False), y: ("last", [], False)}
    read = lambda: {r.sha: (r.subject, [f.path for f in r.files], r.date is None) for r in gitlog.git_log(spark, str(tmp_path / "log")).collect()}
    assert read() == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("60b", "100b", "200b"):  # headers and their counts in different splits
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            assert read() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_git_graph(spark):
    rows = [("m", ["b", "c"], at(4)), ("c", ["a"], at(3)), ("b", ["a"], at(2)), ("a", ["gone"], at(1)), ("z", None, at(9))]
    p = spark.createDataFrame(rows, "sha string, parents array<string>, date timestamp")
    got = {r.sha: (r.depth, r.position) for r in gitlog.topological_order(p).collect()}
    assert got == {"a": (0, 0), "z": (0, 1), "b": (1, 2), "c": (1, 3), "m": (2, 4)}
    h = [gitlog.parent_graph_hash(x.withColumn("r", F.lit(1)), ["r"]).first().hash for x in (p, p.orderBy("sha"), p.where("sha != 'z'"))]
    assert h[0] == h[1] != h[2]
    events = json.dumps([{"event": "cross-referenced", "source": {"type": "issue", "issue": {"number": 5, "pull_request": {"url": "u"}}}}, {"event": "cross-referenced", "source": {"issue": {"number": 6}}}, {"event": "closed", "commit_id": "abc"}, {"event": "labeled"}])
    t = spark.createDataFrame([(1, 9, events), (1, 8, None), (1, 7, "[")], "repo_id int, issue_number int, events string")
    assert [(r.issue_number, r.event, r.source_type, r.source_number, r.source_sha) for r in gitlog.timeline_events(t).collect()] == [(9, "cross-referenced", "pr", 5, None), (9, "cross-referenced", "issue", 6, None), (9, "closed", "commit", None, "abc"), (9, "labeled", None, None, None)]
    f = spark.createDataFrame([("src/a.go",), ("vendor/a.go",), ("a.pb.go",), ("README.md",), ("lib/testdata/b.py",), ("x.min.js",)], "path string")
    assert [r.path for r in gitlog.source_files(f).collect()] == ["src/a.go"]


def test_identities_of_files(spark):
    r = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "a", "d"), (1, "x", "x"), (1, "p", "q"), (1, "q", "p"), (1, None, "n")], "repo_id int, former string, path string")
    assert {(x.repo_id, x.canonical): x.former for x in tables.identity_map(r).collect()} == {(1, "c"): ["a", "b"], (2, "d"): ["a"]}
    i = spark.createDataFrame([(1, "c", ["a", "b"]), (1, "k", [])], "repo_id int, canonical string, former array<string>")
    m = spark.createDataFrame([(1, "b", "e"), (1, "new0", "new1"), (2, "c", "z")], "repo_id int, former string, path string")
    assert {(x.repo_id, x.canonical): x.former for x in tables.move_identities(i, m).collect()} == {(1, "e"): ["a", "b", "c"], (1, "k"): [], (1, "new1"): ["new0"], (2, "z"): ["c"]}


def test_queue_of_failures(spark):
    q = spark.createDataFrame([(1, "a", "old", 4, at(1)), (1, "b", "old", 0, at(1))], "repo_id int, commit_sha string, error_message string, retry_count int, updated_at timestamp")
    f = spark.createDataFrame([(1, "a", "x", at(3)), (1, "a", "y", at(4)), (2, "c", "z", at(3)), (2, "c", "w", at(2))], "repo_id int, commit_sha string, error_message string, at timestamp")
    n = tables.enqueue_failures(q, f)
    assert {(r.repo_id, r.commit_sha): (r.error_message, r.retry_count) for r in n.collect()} == {(1, "a"): ("y", 6), (1, "b"): ("old", 0), (2, "c"): ("z", 1)}
    assert {r.commit_sha for r in tables.retries(n).collect()} == {"b", "c"} and {r.commit_sha for r in tables.purge(n, F.lit(at(2))).collect()} == {"a", "c"}
    rows = spark.createDataFrame([(1, None), (2, None)], "id int, processed_at timestamp")
    assert [r.id for r in tables.mark_processed(rows, rows.where("id = 1"), F.lit(at(5))).where("processed_at IS NOT NULL").collect()] == [1]


def test_large_commits_are_split(spark, monkeypatch):
    rows = [("big", f"b{i:03d}", at(1)) for i in range(60)] + [("small", "b001", at(2)), ("small", "b002", at(2)), ("big", "b001", at(1))]
    c = spark.createDataFrame(rows, "sha string, block string, at timestamp")
    whole = {tuple(r) for r in coupling.cochange_pairs(c, now(), min_count=1, min_rate=0).collect()}
    files = {tuple(r) for r in coupling.file_cochange(c, 0.0).collect()}
    monkeypatch.setattr(coupling, "SPLIT", 7)
    assert {tuple(r) for r in coupling.cochange_pairs(c, now(), min_count=1, min_rate=0).collect()} == whole and len(whole) == 60 * 59 // 2
    assert {tuple(r) for r in coupling.file_cochange(c, 0.0).collect()} == files
    two = c.withColumn("repo_id", F.lit(1)).unionByName(c.withColumn("repo_id", F.lit(2)))
    assert coupling.cochange_pairs(two, now(), min_count=1, min_rate=0, by=("repo_id",)).count() == 2 * len(whole)


def test_links_are_selected(spark):
    rows = [(1, 1, 10, 0.66), (1, 1, 11, 0.64), (1, 2, 20, 0.90), (1, 2, 21, 0.88), (1, 2, 22, 0.79), (2, 1, 30, 0.50), (2, 2, 40, 0.80), (2, 2, 41, 0.78), (2, 2, 42, 0.77), (2, 2, 43, 0.76)]
    s = spark.createDataFrame(rows, "repo_id int, issue int, candidate int, score double")
    got = {(r.repo_id, r.issue, r.candidate): r.quality for r in summary.select_links(s).collect()}
    assert got == {(1, 1, 10): "medium", (1, 2, 20): "low", (1, 2, 21): "low", (2, 2, 40): "low", (2, 2, 41): "low", (2, 2, 42): "low"}
    assert {r.issue for r in summary.select_links(s.withColumn("unsure", F.lit(True))).where("repo_id = 1").collect()} == {2}
    braked = s.withColumn("delta_seconds", F.lit(85.0)).withColumn("window_seconds", F.lit(100.0)).withColumn("title_score", F.when(F.col("candidate") == 20, 0.6))
    assert {(r.repo_id, r.issue) for r in summary.select_links(braked).collect()} == {(1, 2)}


def test_nulls_are_values_of_their_own(spark):
    w = spark.createDataFrame([("a", None), (None, "a"), (None, None)], "name string, brand string")
    k = spark.createDataFrame([(1, "a", "z"), (2, "y", "a")], "id int, name string, brand string")
    got = {(r["name"], r.brand): r.id for r in summary.match_by_tiers(w, k, [["name"], ["brand"]], "id", "none").collect()}
    assert got == {("a", None): "1", (None, "a"): "2", (None, None): "none"}
    b = spark.createDataFrame([(None, 5), (None, 1), ("g", 2)], "g string, incidents int").withColumns({"last_at": F.lit(at(30)), "staleness_days": F.lit(0), "complexity": F.lit(1), "couplings": F.lit(0), "avg_rate": F.lit(0.0)})
    assert sorted(round(r.risk_score) for r in risk.composite_risk(b, now(), ["g"]).collect()) == [20, 100, 100]
    kinds = spark.createDataFrame([(["Enhancement", "x"],), (["Docs", "BUG-1"],)], "l array<string>")
    assert [r[0] for r in kinds.select(incidents.incident_type(F.col("l"))).collect()] == ["Enhancement", "bug"]


def test_commit_files_of_every_shape(spark):
    f = lambda name, **more: {"filename": name, "status": "modified", "additions": 2, "deletions": 1, "patch": "@@ -1,2 +3 @@\n+x"} | more
    s = json.dumps
    shapes = {
        "root": (s({"files": [f("a"), f("b")]}), "ab"), "key": (s({"changed_files": [f("a")]}), "a"), "deep": (s({"payload": {"files": [f("a")]}, "version": 2}), "a"), "both": (s({"payload": {"changed_files": [f("a")]}}), "a"),
        "lone": (s({"files": f("a")}), "a"), "text": (s(s({"files": [f("a")]})), "a"), "twice": (s(s(s({"payload": {"files": f("a")}}))), "a"), "inner": (s({"payload": s({"files": [f("a")]})}), "a"), "items": (s({"files": [s(f("a"))]}), "a"),
        "array": (s([f("a")]), "a"), "mark": ("\ufeff" + s({"files": [f("a")]}), "a"), "escaped": (s({"files": [f("a")]}).replace("filename", "file\\u006eame"), "a"), "patch": (s({"files": [f("a", patch=s(f("b")))]}), ""),
        "odd": (s({"files": [f("a", additions=2**40, deletions="1", status=None), {"filename": None}, {"patch": "@@ -1 +1 @@"}, None, 3]}), "a"), "half": (s({"files": [f("\ud800")]}), "?"), "cut": (s({"files": [f("a")]})[:-1], ""), "blank": (" ", ""), "none": (None, ""),
    }
    rows = gitlog.commit_files(spark.createDataFrame([(1, k, v) for k, (v, _) in shapes.items()], "repo_id long, sha string, raw_data string"))
    got = {}
    for r in rows.select("*", F.explode(diff.hunks(F.col("patch"))).alias("h")).orderBy("filename").collect():
        got[r.sha] = got.get(r.sha, "") + r.filename
        assert tuple(r.h) == (1, 2, 3, 1) and r.repo_id == 1
    assert got == {k: names for k, (_, names) in shapes.items() if names}
    odd = [tuple(r) for r in rows.where("sha = 'odd'").select("filename", "status", "additions", "deletions").collect()]
    assert odd == [("a", None, None, None)]


def test_streams(spark, tmp_path):
    rows = [("u", 2, "DELETE"), ("u", 1, "MODIFY"), ("u", 3, "DELETE"), ("v", 1, "CREATE"), ("v", 2, "CREATE"), ("w", 1, "RENAME"), ("w", 2, "MOVE")]
    spark.createDataFrame(rows, "unit string, seq int, behavior string").write.parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.fold_units(streams.read_table(spark, str(tmp_path / "in"))), str(tmp_path / "folded"), "update")
    assert {r.unit: (r.state, r.changes) for r in streams.last_states(out, "unit").collect()} == {"u": ("absent", 2), "v": ("present", 2), "w": ("present", 2)}
    spark.createDataFrame([("u", 4, "MODIFY")], "unit string, seq int, behavior string").write.mode("append").parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.fold_units(streams.read_table(spark, str(tmp_path / "in"))), str(tmp_path / "folded"), "update")
    assert {r.unit: (r.state, r.changes) for r in streams.last_states(out, "unit").collect()} == {"u": ("present", 3), "v": ("present", 2), "w": ("present", 2)}
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.limit(500).write.parquet(str(tmp_path / "ev"))
    batch = {(r.start, r.event_type): r.n for r in streams.windowed_counts(spark.read.parquet(str(tmp_path / "ev"))).collect()}
    live = streams.windowed_counts(streams.read_table(spark, str(tmp_path / "ev"))).withColumn("key", F.struct("start", "event_type")).select("key", "n")
    live = streams.last_states(streams.run_once(live, str(tmp_path / "hours"), "update"), "key")
    assert {(r.key.start, r.key.event_type): r.n for r in live.collect()} == batch
