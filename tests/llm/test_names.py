"""Linking of variant spellings, the similarity join against brute force, corner cases."""

import random

from pyspark.sql import functions as F

from changeprism.llm import names
from changeprism.llm.names import JACCARD, Q, Reader, errors, fold, identities, linked, members, one_error, shared_hosts, similar_tokens
from changeprism.session import cut_lineage


def test_reading():
    r = Reader()
    for name, email, login, given, family, org in (
        ("PÄMMARBACH Theodora", "theodorapaemmarbach400@yahoo.example", None, "theodora", "paemmarbach", ""),
        ("Slölvoac, Björn", "bjoern.sloelvoac@alum.brightcrestrine.test", None, "bjoern", "sloelvoac", "brightcrestrine"),
        ("Bill Züthaano", "wzuethaano@brightvalevasu.example", "wzuethaano", "william", "zuethaano", "brightvalevasu"),
        ("Lupita Mcaulbaaac", "mcaulbaac.g@eng.brightstonenepo.example", None, "guadalupe", "mcaulbaac", "brightstonenepo"),
        ("Zoë Øüthaano", "zoeuethaano@brightmoorketa.example", None, "zoe", "oeuethaano", "brightmoorketa"),
        ("Věra Válbubach", "vera@valbubach-laptop.invalid", None, "vera", "valbubach", ""),
    ):
        t = r.read(name, email, login)
        assert (t["given"], t["family"], t["org"]) == (given, family, org), t
    assert r.read("Brightcrestbaba Sofware GmbH", "team@brightcrestbaba.example", None)["role"] == "1"
    assert r.read(None, None, None)["family"] == "" and r.read("", "x", "")["org"] == ""
    assert one_error("abcd", "abdc") and one_error("abc", "abxc") and not one_error("abc", "xyz") and fold("Øß") == "oess"


def grams(s):
    s = f"^{s}$"
    return {s[i : i + Q] for i in range(max(len(s) - Q + 1, 1))}


def test_join_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9)))
    left, right = [(str(i % 3), word()) for i in range(150)], [(str(i % 3), word()) for i in range(150)]
    got = {tuple(r) for r in similar_tokens(spark.createDataFrame(left, "block string, token string"), spark.createDataFrame(right, "block string, token string")).collect()}
    want = {(b, x, y) for b, x in left for c, y in right if b == c and len(grams(x) & grams(y)) >= JACCARD * len(grams(x) | grams(y))}
    assert got == want


def test_links(spark):
    devs = spark.createDataFrame(
        [
            (1, 1, "Zoë Lentaretti", "zoe.lentaretti@acmeworks.example", "zolent"), (2, 2, "LENTARETTI Zoe", "zlentaretti@acmeworks.example", None), (3, 3, "zolent", "99+zolent@users.noreply.h.example", "ZOLENT"),
            (4, 1, "Zozo Lentaretti", "zoelentaretti300@gmail.example", None), (5, 1, "Edmund Other", "edmund.other@acmeworks.example", None), (6, 1, None, None, None),
            (7, 4, "Zoe Lentaretti", "zoe.lentaretti@elsewhere.example", None), (8, 2, "Acmeworks Systems", "team@acmeworks.example", None), (9, 3, "Acmeworks GmbH", "dev@acmeworks.example", None),
        ],
        "id long, repo_id long, name string, email string, github_login string",
    )
    commits = spark.createDataFrame(
        [(10, 1, "Zoe Lentareti", "zoe@lentaretti-laptop.invalid"), (11, 1, "Zoe Lentaretti", " ZOE.lentaretti@acmeworks.example "), (12, 2, "X Y", None), (13, None, None, None), (14, 1, "Zoe Lentaretti", "zoe_lentaretti@acmeworks.test"), (10, 1, "Zoe Lentareti", "zoe@lentaretti-laptop.invalid")],
        "id long, repo_id long, author_name string, author_email string",
    )
    got = {tuple(r) for r in linked(devs, commits).collect()}
    dd, cd = {p[1:] for p in got if p[0] == "developer_developer"}, {p[1:] for p in got if p[0] != "developer_developer"}
    assert {(1, 2), (1, 3), (2, 3), (1, 4), (8, 9)} <= dd and not {p for p in dd if {5, 6, 7} & set(p)}
    assert cd == {(10, 1), (10, 4), (14, 1), (14, 4)}
    assert linked(devs.limit(0), commits).count() == 0


def test_unresolved_identities_stand_for_themselves(spark):
    devs = spark.createDataFrame(
        [
            # two persons of one name; the free address belongs to neither for certain
            (1, 1, "Robert Smithson", "robert.smithson@acmeworks.example", None), (2, 1, "Robert Smithson", "robert.smithson@otherworks.example", None), (3, 2, "Robert Smithson", "rsmithson7@gmail.example", None), (4, 3, "Bob Smithson", " RSmithson7@gmail.example", None),
            (5, 4, "J. Smithers", "jsmithers9@gmail.example", None), (6, 5, "J. Smithers", "jsmithers9@gmail.example", None), (7, 6, None, None, "zq-x1"), (8, 7, None, None, "ZQ-x1 "),
            (9, 4, None, "root@localhost", None), (10, 5, None, "root@localhost", None), (11, 8, "J. Wetherbee", None, None), (12, 9, "J. Wetherbee", None, None),
            # two accounts of one name, one of them with the address
            (13, 1, "Robert Kingsley", "kingsley1@gmail.example", "robking"), (14, 1, "Robert Kingsley", "kingsley2@gmail.example", "kingrob"), (15, 2, "Robert Kingsley", "kingsley2@gmail.example", None), (16, 4, None, None, None), (17, 5, None, "", ""),
        ],
        "id long, repo_id long, name string, email string, github_login string",
    )
    commits = spark.createDataFrame([(20, 3, "Robert Smithson", "nobody@localhost")], "id long, repo_id long, author_name string, author_email string")
    dd = {(r.left_id, r.right_id) for r in linked(devs, commits).collect() if r.link_kind == "developer_developer"}
    assert dd == {(3, 4), (5, 6), (7, 8), (11, 12), (14, 15)}


def test_exchanges_are_one_error(spark):
    pairs = spark.createDataFrame([("abcd", "abdc"), ("abcd", "badc"), ("abcd", "abcd"), ("lopez", "lpoez"), ("ab", "xy")], "a string, b string")
    assert [r[0] for r in pairs.select(errors(F.col("a"), F.col("b"))).collect()] == [1, 3, 0, 1, 2]


def test_hosts_of_many_homes_are_shared(spark):
    rows = [(f"Robert Family{c}son", f"robert.family{c}son@firm{c}.example", None) for c in "abcdefgh"] + [(f"Robert Family{c}son", f"rfamily{c}son@bigmail.example", None) for c in "abcdefgh"]
    ids = identities(spark.createDataFrame(rows, "name string, email string, login string"))
    assert [r.org for r in shared_hosts(ids).collect()] == ["bigmail"]


def test_plans_stay_short(spark, monkeypatch):
    """The parts used most often are cut first: the driver's memory goes into plans, not rows."""
    nodes = []

    def cut(df, eager=True):
        nodes.append(len(df._jdf.queryExecution().executedPlan().toString().splitlines()))
        return cut_lineage(df, eager)

    monkeypatch.setattr(names, "cut_lineage", cut)
    devs = spark.createDataFrame([(1, 1, "Robert Smithson", "robert.smithson@acmeworks.example", "robsm"), (2, 2, "Acmeworks Systems", "team@acmeworks.example", None)], "id long, repo_id long, name string, email string, github_login string")
    commits = spark.createDataFrame([(10, 1, "Bob Smithson", "x@localhost")], "id long, repo_id long, author_name string, author_email string")
    linked(devs, commits)
    assert max(nodes) < 250 and sum(nodes) < 1000, nodes


def test_links_come_through_the_join(spark, monkeypatch):
    devs = spark.createDataFrame([(1, 1, "Robert Smithson", "robert.smithson@acmeworks.example", "robsm"), (2, 2, "Smithson, Bob", "rsmithson@acmeworks.example", None), (3, 3, "Bob Smithson", None, "robsm")], "id long, repo_id long, name string, email string, github_login string")
    commits = spark.createDataFrame([], "id long, repo_id long, author_name string, author_email string")
    assert {tuple(r)[1:] for r in linked(devs, commits).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert len({r.entity for r in members(devs, commits).collect()}) == 1
    real = names.similar_tokens
    monkeypatch.setattr(names, "similar_tokens", lambda a, b: real(a, b).limit(0))
    assert linked(devs, commits).count() == 0


def test_most_links_of_a_whole_table_come_through_the_join(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    devs = spark.read.parquet(f"{d}/github_developers.parquet").select("id", "repo_id", "name", "email", "github_login")
    commits = spark.read.parquet(f"{d}/github_commits.parquet").select("id", "repo_id", "author_name", "author_email")
    links = {tuple(r) for r in linked(devs, commits).collect()}
    real = names.similar_tokens
    monkeypatch.setattr(names, "similar_tokens", lambda a, b: real(a, b).limit(0))
    assert len(links & {tuple(r) for r in linked(devs, commits).collect()}) < len(links) / 4


def test_identities_that_differ_in_nulls_differ(spark):
    devs = spark.createDataFrame([(1, 1, "Robert Smithson", "robert.smithson@acmeworks.example", None)], "id long, repo_id long, name string, email string, github_login string")
    commits = spark.createDataFrame([(10, 1, None, "robert smithson"), (11, 1, "robert smithson", None), (12, 1, None, None)], "id long, repo_id long, author_name string, author_email string")
    assert {tuple(r)[1:] for r in linked(devs, commits).collect()} == {(11, 1)}


def test_typing_errors_in_any_repository(spark):
    devs = spark.createDataFrame(
        [
            (1, 1, "Robert Smithson", "robert.smithson@acmeworks.example", None), (2, 2, "Robert Smihtson", None, None), (3, 3, "Bob Smithsn", None, None), (4, 4, "Michael Smihtson", None, None),
            (5, 5, "Michael Barlowe", "michael.barlowe@acmeworks.example", None), (6, 6, "Michael Crandall", "michael.crandall@acmeworks.example", None),
        ],
        "id long, repo_id long, name string, email string, github_login string",
    )
    commits = spark.createDataFrame([(20, 5, "Mike Bralowe", "x@localhost")], "id long, repo_id long, author_name string, author_email string")
    assert {tuple(r)[1:] for r in linked(devs, commits).collect()} == {(1, 2), (1, 3), (2, 3), (20, 5)}
