"""Queries of link quality, link acceptance and matching metrics over issues, pull requests and links, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeprism.functions import text
from changeprism.operators import linking, quality, summary, tables
from changeprism.plans.graph import _LAST, issues, pulls
from changeprism.plans.history import _KEYS, _words
from changeprism.plans.registry import Registry, as_of, r6
from changeprism.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _links(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "github_issue_pr_links", "id", "repo_id", "issue_number", "final_confidence", "evidence_sources", "temporal_analysis", "semantic_analysis")
    num = lambda c, p: F.get_json_object(c, f"$.{p}").try_cast("double")
    return t.select(
        "id", "repo_id", "issue_number", F.col("final_confidence").alias("confidence"), F.col("evidence_sources").alias("evidence"), num("temporal_analysis", "temporal_delta_seconds").alias("delta_seconds"),
        F.col("semantic_analysis").isNotNull().alias("analysed"), *(num("semantic_analysis", f"{n}_score").alias(f"{n}_score") for n in ("title", "body", "comment")),
    )


def _excluded(s: SparkSession, d: str) -> DataFrame:
    """Issues labelled docs stand for those that need no link."""
    return issues(s, d).where("labels LIKE '%\"docs\"%'").select("repo_id", "number", F.lit("wontfix").alias("classification"))


_N = """n AS (SELECT repo_id, issue_number, final_confidence AS c, evidence_sources AS e, semantic_analysis IS NOT NULL AS analysed, abs(try_cast(try_cast(temporal_analysis AS JSON) ->> '$.temporal_delta_seconds' AS DOUBLE)) AS d,
coalesce(try_cast(try_cast(semantic_analysis AS JSON) ->> '$.title_score' AS DOUBLE), 0) AS ts, coalesce(try_cast(try_cast(semantic_analysis AS JSON) ->> '$.body_score' AS DOUBLE), 0) AS bs, coalesce(try_cast(try_cast(semantic_analysis AS JSON) ->> '$.comment_score' AS DOUBLE), 0) AS cs FROM github_issue_pr_links)"""
_COVER = """v AS (SELECT repo_id, count(*) AS total_closed, count(*) FILTER (closed_at IS NOT NULL AND NOT coalesce(labels LIKE '%"docs"%', false)) AS eligible FROM i WHERE state = 'closed' GROUP BY 1),
k AS (SELECT repo_id, count(DISTINCT issue_number) AS linked FROM n WHERE c >= 5e-1 GROUP BY 1), cover AS (SELECT v.*, coalesce(linked, 0) AS linked, eligible - coalesce(linked, 0) AS unlinked FROM v LEFT JOIN k USING (repo_id))"""
_KINDS = """x AS (SELECT repo_id, coalesce(list_contains(e, 'explicit'), false) AS explicit, coalesce(list_contains(e, 'github_timeline_verified'), false) AS github_timeline_verified, coalesce(list_contains(e, 'bidirectional'), false) AS bidirectional,
coalesce(list_has_any(e, ['semantic_title', 'semantic_body', 'semantic_comment']), false) AS semantic, coalesce(list_contains(e, 'temporal'), false) AS temporal, coalesce(list_contains(e, 'file_context'), false) AS file_context FROM n),
y AS (SELECT *, explicit::INT + github_timeline_verified::INT + bidirectional::INT + semantic::INT + temporal::INT + file_context::INT AS kinds FROM x)"""


@query(f"WITH {_LAST}, {_N}, {_COVER} SELECT * FROM cover")
def link_coverage(s, d):
    return quality.link_coverage(issues(s, d), _links(s, d), _excluded(s, d))


@query(f"""WITH {_N}, {_KINDS} SELECT repo_id, round(avg(kinds), 6) AS avg_kinds, count(*) FILTER (kinds = 3) AS kinds_3, count(*) FILTER (kinds = 2) AS kinds_2, count(*) FILTER (kinds = 1) AS kinds_1,
count(*) FILTER (bidirectional) AS bidirectional, count(*) FILTER (semantic) AS semantic, count(*) FILTER (temporal) AS temporal, count(*) AS links FROM y GROUP BY 1""")
def link_evidence_diversity(s, d):
    return quality.evidence_diversity(_links(s, d)).select("repo_id", *r6("avg_kinds"), "kinds_3", "kinds_2", "kinds_1", "bidirectional", "semantic", "temporal", "links")


@query(f"WITH {_N} SELECT repo_id, count(*) AS timed, count(*) FILTER (d < 3600) AS tight, count(*) FILTER (d < 300) AS minutes5, count(*) FILTER (d >= 300 AND d < 3600) AS hour, count(*) FILTER (d >= 3600 AND d < 86400) AS day, count(*) FILTER (d >= 86400) AS later FROM n WHERE d IS NOT NULL GROUP BY 1")
def link_temporal_precision(s, d):
    return quality.temporal_precision(_links(s, d))


@query(f"WITH {_N}, g AS (SELECT *, greatest(ts, bs, cs) AS best FROM n WHERE analysed) SELECT repo_id, count(*) AS scored, round(avg(best), 6) AS avg_max, count(*) FILTER (best >= 7e-1) AS high, count(*) FILTER (best >= 5e-1 AND best < 7e-1) AS medium, count(*) FILTER (best < 5e-1) AS low, round(avg(ts), 6) AS avg_title FROM g GROUP BY 1")
def link_semantic_strength(s, d):
    return quality.semantic_strength(_links(s, d)).select("repo_id", "scored", *r6("avg_max"), "high", "medium", "low", *r6("avg_title"))


@query(f"""WITH {_LAST}, {_N}, {_COVER}, a AS (SELECT repo_id, count(DISTINCT issue_number) AS linked FROM n GROUP BY 1), b AS (SELECT repo_id, count(*) AS links, avg(c) AS ac FROM n GROUP BY 1)
SELECT cover.repo_id, total_closed, eligible, coalesce(a.linked, 0) AS linked, coalesce(links, 0) AS links, round(coalesce(ac, 0), 6) AS avg_confidence FROM cover LEFT JOIN a USING (repo_id) LEFT JOIN b USING (repo_id)""")
def link_quality_statistics(s, d):
    return quality.quality_statistics(issues(s, d), _links(s, d), _excluded(s, d)).select("repo_id", "total_closed", "eligible", "linked", "links", *r6("avg_confidence"))


_QUALITY = f"""WITH {_LAST}, {_N}, {_COVER}, {_KINDS}, t AS (SELECT repo_id, count(*) FILTER (c >= 85e-2) AS hn, coalesce(avg(c) FILTER (c >= 85e-2), 0) AS ha, count(*) FILTER (c >= 7e-1 AND c < 85e-2) AS mn, coalesce(avg(c) FILTER (c >= 7e-1 AND c < 85e-2), 0) AS ma,
count(*) FILTER (c < 7e-1) AS ln, coalesce(avg(c) FILTER (c < 7e-1), 0) AS la FROM n GROUP BY 1), g AS (SELECT repo_id, avg(kinds) AS ak, count(*) FILTER (bidirectional) AS bi, count(*) AS links FROM y GROUP BY 1),
h AS (SELECT repo_id, count(*) FILTER (d < 3600) * 100e0 / count(*) AS pr FROM n WHERE d IS NOT NULL GROUP BY 1), z AS (SELECT repo_id, avg(greatest(ts, bs, cs)) * 100 AS st FROM n WHERE analysed GROUP BY 1),
f AS (SELECT cover.*, coalesce(ln, 0) AS low_n, coalesce(bi, 0) AS bidirectional, coalesce(links, 0) AS links, coalesce(ak, 0) AS avg_kinds, linked * 100e0 / eligible AS coverage, 100e0 * coalesce((hn * ha + mn * ma * 7e-1 + ln * la * 3e-1) / nullif(hn + mn * 7e-1 + ln * 3e-1, 0), 0) AS confidence,
coalesce(ak, 0) / 6e0 * 100 AS diversity, coalesce(pr, 0) AS precision, coalesce(st, 0) AS strength FROM cover LEFT JOIN t USING (repo_id) LEFT JOIN g USING (repo_id) LEFT JOIN h USING (repo_id) LEFT JOIN z USING (repo_id) WHERE total_closed >= 5 AND eligible > 0),
q AS (SELECT *, round(coverage * 4e-1 + confidence * 35e-2 + diversity * 15e-2 + precision * 5e-2 + strength * 5e-2, 9) AS score FROM f)"""


def _quality(s: SparkSession, d: str) -> DataFrame:
    """Five closed issues are enough here, so that small tables have such repositories."""
    return quality.link_quality(issues(s, d), _links(s, d), _excluded(s, d), 5)


@query(_QUALITY + """ SELECT repo_id, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence, round(diversity, 6) AS diversity, round(precision, 6) AS precision, round(strength, 6) AS strength, round(score, 6) AS score,
CASE WHEN score >= 97 THEN 'A+' WHEN score >= 93 THEN 'A' WHEN score >= 90 THEN 'A-' WHEN score >= 87 THEN 'B+' WHEN score >= 83 THEN 'B' WHEN score >= 80 THEN 'B-' WHEN score >= 77 THEN 'C+' WHEN score >= 73 THEN 'C' WHEN score >= 70 THEN 'C-' WHEN score >= 67 THEN 'D+' WHEN score >= 63 THEN 'D' WHEN score >= 60 THEN 'D-' ELSE 'F' END AS grade,
CASE WHEN score >= 90 THEN 'World-Class' WHEN score >= 80 THEN 'High Quality' WHEN score >= 70 THEN 'Moderate Quality' WHEN score >= 60 THEN 'Below Average' ELSE 'Poor Quality' END AS rank,
CASE WHEN score >= 90 THEN 1e0 WHEN score >= 80 THEN 9e-1 WHEN score >= 70 THEN 75e-2 WHEN score >= 60 THEN 5e-1 ELSE 25e-2 END AS multiplier,
CASE WHEN coverage >= 90 THEN 'Excellent' WHEN coverage >= 80 THEN 'Good' WHEN coverage >= 70 THEN 'Fair' ELSE 'Poor' END AS coverage_status, CASE WHEN precision >= 80 THEN 'Excellent' WHEN precision >= 60 THEN 'Good' WHEN precision >= 40 THEN 'Fair' ELSE 'Poor' END AS precision_status FROM q""")
def link_quality_score(s, d):
    return _quality(s, d).select("repo_id", *r6("coverage", "confidence", "diversity", "precision", "strength", "score"), "grade", "rank", "multiplier", "coverage_status", "precision_status")


@query(_QUALITY + """, r AS (SELECT repo_id, low_n, [CASE WHEN unlinked > 0 THEN 'coverage ' || CASE WHEN coverage >= 90 THEN 'low' WHEN coverage >= 80 THEN 'medium' ELSE 'high' END END, CASE WHEN low_n > 0 THEN 'confidence ' || CASE WHEN low_n * 100e0 / links > 20 THEN 'high' ELSE 'medium' END END,
CASE WHEN links > 0 AND avg_kinds < 4 THEN 'diversity low' END, CASE WHEN links > 0 AND bidirectional < links // 2 THEN 'diversity low' END, CASE WHEN precision < 60 THEN 'precision ' || CASE WHEN precision < 40 THEN 'high' ELSE 'medium' END END, CASE WHEN strength < 70 THEN 'strength low' END,
CASE WHEN least(coverage, confidence, diversity, precision, strength) < 70 THEN 'overall high' END] AS a FROM q) SELECT repo_id, list_filter(a, lambda x: x IS NOT NULL) AS advice, round(least(5e0, low_n * 5e-2), 6) AS gain FROM r""")
def link_quality_advice(s, d):
    a = quality.advice(_quality(s, d))
    return a.select("repo_id", F.transform("advice", lambda x: F.concat_ws(" ", x["category"], x["impact"])).alias("advice"), *r6("gain"))


@query("SELECT repo_id, arg_max(final_confidence, (updated_at, final_confidence)) AS score, max(updated_at) AS computed_at FROM github_issue_pr_links WHERE updated_at IS NOT NULL AND final_confidence IS NOT NULL GROUP BY 1")
def link_latest_scores(s, d):
    """The newest link's confidence stands for a stored score."""
    t = table(s, d, "github_issue_pr_links", "repo_id", "updated_at", "final_confidence").where("updated_at IS NOT NULL AND final_confidence IS NOT NULL")
    t = t.groupBy("repo_id", F.col("updated_at").alias("computed_at")).agg(F.max("final_confidence").alias("score"))
    return quality.latest_scores(t)


_TAGS = "list_transform(coalesce(evidence_sources, []), lambda v: CASE v WHEN 'ref_fixes' THEN 'explicit' WHEN 'temporal' THEN 'temporal_match_1hr' WHEN 'timeline' THEN 'bot_comment' WHEN 'bidirectional' THEN 'bidirectional_mention' ELSE v END)"


@query(f"""WITH {_LAST}, e AS (SELECT repo_id, issue_number, {_TAGS} AS e, try_cast(try_cast(semantic_analysis AS JSON) ->> '$.title_score' AS DOUBLE) AS sem FROM github_issue_pr_links),
o AS (SELECT repo_id, issue_number, bool_or(list_contains(e, 'explicit')) AS x, bool_or(list_contains(e, 'temporal_match_1hr')) AS t, bool_or(list_contains(e, 'bot_comment')) AS c, sum(sem) AS s, count(sem) AS n FROM e GROUP BY 1, 2),
a AS (SELECT i.repo_id, sum(coalesce(x, false)::INT) * 100e0 / count(*) AS explicit, sum(coalesce(t, false)::INT) * 100e0 / count(*) AS temporal, sum(coalesce(c, false)::INT) * 100e0 / count(*) AS comment, coalesce(sum(s) / nullif(sum(n), 0), 0) * 100 AS semantic
FROM i LEFT JOIN o ON o.repo_id = i.repo_id AND o.issue_number = i.number WHERE state = 'closed' GROUP BY 1), b AS (SELECT repo_id, count(*) FILTER (list_contains(e, 'bidirectional_mention')) * 100e0 / count(*) AS bidirectional FROM e GROUP BY 1),
f AS (SELECT a.*, coalesce(bidirectional, 0) AS bidirectional FROM a LEFT JOIN b USING (repo_id)), q AS (SELECT *, round(explicit * 4e-1 + temporal * 25e-2 + comment * 2e-1 + semantic * 1e-1 + bidirectional * 5e-2, 9) AS score FROM f)
SELECT repo_id, round(explicit, 6) AS explicit, round(temporal, 6) AS temporal, round(comment, 6) AS comment, round(semantic, 6) AS semantic, round(bidirectional, 6) AS bidirectional, round(score, 6) AS score,
CASE WHEN score >= 90 THEN 'World-Class' WHEN score >= 75 THEN 'High Quality' WHEN score >= 60 THEN 'Moderate Quality' WHEN score >= 45 THEN 'Below Average' ELSE 'Poor Quality' END AS rank FROM q""")
def link_graph_quality(s, d):
    names = {"ref_fixes": "explicit", "temporal": "temporal_match_1hr", "timeline": "bot_comment", "bidirectional": "bidirectional_mention"}
    m = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    t = table(s, d, "github_issue_pr_links", "repo_id", "issue_number", "evidence_sources", "semantic_analysis")
    e = t.select("repo_id", "issue_number", F.transform("evidence_sources", lambda v: F.coalesce(F.try_element_at(m, v), v)).alias("evidence"), F.get_json_object("semantic_analysis", "$.title_score").try_cast("double").alias("semantic_score"))
    return quality.graph_quality(issues(s, d), e).select("repo_id", *r6("explicit", "temporal", "comment", "semantic", "bidirectional", "score"), "rank")


def _set(c: str) -> str:
    return _KEYS.replace("(k, ", f"({c}, ").replace("_transform(k", f"_transform({c}")


def _alike(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"


_SIMILAR = f"""{_LAST}, m AS (SELECT i.repo_id, i.id AS issue_id, p.id AS pull_id, epoch_us(i.closed_at) - epoch_us(p.merged_at) AS us, i.title AS it, coalesce(i.title, '') || ' ' || coalesce(i.body, '') AS iw, p.title AS pt, coalesce(p.title, '') || ' ' || coalesce(p.body, '') AS pw
FROM i JOIN p ON i.repo_id = p.repo_id AND abs(epoch_us(i.closed_at) - epoch_us(p.merged_at)) < 86400000000), w AS (SELECT repo_id, issue_id, pull_id, us, {_words("it")} AS a, {_words("pt")} AS b, {_words("iw")} AS c, {_words("pw")} AS e FROM m),
g AS (SELECT repo_id, issue_id, pull_id, us, {_set("a")} AS a, {_set("b")} AS b, {_set("c")} AS c, {_set("e")} AS e FROM w), sim AS (SELECT repo_id, issue_id, pull_id, us, round(greatest({_alike("a", "b")}, {_alike("c", "e")}), 9) AS similarity FROM g)"""


def _similar(s: SparkSession, d: str) -> DataFrame:
    """Issues and pull requests within a day, with what their texts have in common. Keywords are read once for each text and not
    for each pair, of which a busy repository has far more."""

    def timed(t: DataFrame, at: str, side: str) -> DataFrame:
        t = t.where(F.col(at).isNotNull()).select(F.col("repo_id").alias("key"), "id", linking.micros(F.col(at)).alias("at"), text.keyword_set(F.col("title")).alias("title"), text.keyword_set(F.col("body")).alias("body"))
        t = t.select("key", "id", "at", text.packed(F.col("title")).alias("title"), text.packed(F.col("body")).alias("body"))
        # no keyword reaches over the blank between title and body
        return t.select("key", "id", "at", F.col("title").alias(f"{side}_title"), text.packed_union(F.col("title"), F.col("body")).alias(f"{side}_whole"))

    n = linking.within(timed(issues(s, d, "body"), "closed_at", "i"), timed(pulls(s, d, "body"), "merged_at", "p"))
    both = [(x, F.col(f"i_{x}"), F.col(f"p_{x}")) for x in ("title", "whole")]
    n = n.select("key", "left_id", "right_id", "delta_us", *(text.packed_common(i, p).alias(x) for x, i, p in both), *((text.packed_size(i) + text.packed_size(p)).alias(f"{x}_words") for x, i, p in both))
    alike = F.greatest(*(F.coalesce(F.try_divide(x, F.col(f"{x}_words") - F.col(x)), F.lit(0.0)) for x in ("title", "whole")))
    return n.select(F.col("key").alias("repo_id"), F.col("left_id").alias("issue_id"), F.col("right_id").alias("pull_id"), F.col("delta_us").alias("us"), F.round(alike, 9).alias("similarity"))


@query(f"WITH {_SIMILAR} SELECT issue_id, pull_id, round(similarity, 6) AS similarity FROM sim")
def text_issue_pull_similarity(s, d):
    return _similar(s, d).select("issue_id", "pull_id", *r6("similarity"))


@query(f"""WITH {_SIMILAR}, b AS (SELECT *, CASE WHEN abs(us) < 300000000 THEN 75e-2 WHEN abs(us) < 3600000000 THEN 65e-2 ELSE 55e-2 END AS base FROM sim WHERE similarity >= 1e-1 OR abs(us) < 3600000000)
SELECT issue_id, pull_id, round(CASE WHEN similarity >= 2e-1 THEN least(base + 1e-1, 98e-2) WHEN similarity >= 1e-1 THEN least(base + 5e-2, 98e-2) ELSE base END, 6) AS confidence,
CASE WHEN abs(us) < 300000000 THEN 'temporal_match_5min' WHEN abs(us) < 3600000000 THEN 'temporal_match_1hr' ELSE 'temporal_match_24hr' END || CASE WHEN similarity >= 1e-1 THEN ' semantic_boost' ELSE '' END AS evidence FROM b""")
def link_accepted(s, d):
    # a filter on what explode gives is not moved into the join, where the texts would be compared again for each use
    n = _similar(s, d).select("issue_id", "pull_id", "us", F.explode(F.array("similarity")).alias("similarity"))
    a = n.select("issue_id", "pull_id", linking.accepted(F.col("us"), F.col("similarity")).alias("a")).where("a IS NOT NULL")
    return a.select("issue_id", "pull_id", F.round("a.confidence", 6).alias("confidence"), F.concat_ws(" ", "a.evidence").alias("evidence"))


@query(f"""WITH {_LAST}, n AS (SELECT i.id AS issue_id, c.id AS commit_id, abs(epoch_us(i.closed_at) - epoch_us(c.author_date)) AS us FROM i JOIN c ON i.repo_id = c.repo_id AND abs(epoch_us(i.closed_at) - epoch_us(c.author_date)) < 86400000000)
SELECT issue_id, commit_id, CASE WHEN us < 300000000 THEN 75e-2 WHEN us < 3600000000 THEN 65e-2 ELSE 55e-2 END AS confidence FROM n""")
def link_commits_within_day(s, d):
    t = tables.latest(table(s, d, "github_commits", "id", "repo_id", "sha", "author_date", "fetched_at"), ["repo_id", "sha"])
    i = issues(s, d).select(F.col("repo_id").alias("key"), "id", linking.micros(F.col("closed_at")).alias("at"))
    c = t.select(F.col("repo_id").alias("key"), "id", linking.micros(F.col("author_date")).alias("at"))
    return linking.within(i, c).select(F.col("left_id").alias("issue_id"), F.col("right_id").alias("commit_id"), linking.temporal_confidence(F.col("delta_us")).alias("confidence"))


_TIME = "us AS (SELECT id, final_confidence AS c, try_cast(try_cast(temporal_analysis AS JSON) ->> '$.temporal_delta_seconds' AS DOUBLE) * 1000000 AS us, evidence_sources AS e FROM github_issue_pr_links WHERE final_confidence IS NOT NULL)"


@query(f"""WITH {_TIME} SELECT id, round(CASE WHEN us IS NULL THEN c ELSE least(98e-2, c + CASE WHEN abs(us) < 300000000 THEN 15e-2 WHEN abs(us) < 3600000000 THEN 1e-1 WHEN abs(us) < 86400000000 THEN 5e-2 ELSE 0 END) END, 6) AS confidence,
round(least(98e-2, c + greatest(coalesce(len(list_distinct(e)), 0) - 1, 0) * 3e-2), 6) AS combined, c < 5e-1 AS review FROM us""")
def link_boosts(s, d):
    t = table(s, d, "github_issue_pr_links", "id", "final_confidence", "temporal_analysis", "evidence_sources").where("final_confidence IS NOT NULL")
    us = F.get_json_object("temporal_analysis", "$.temporal_delta_seconds").try_cast("double") * 1_000_000
    c = F.col("final_confidence")
    return t.select("id", F.round(linking.time_boosted(c, us), 6).alias("confidence"), F.round(linking.evidence_boosted(c, F.col("evidence_sources")), 6).alias("combined"), linking.needs_review(c).alias("review"))


@query("""SELECT id, list_filter([CASE WHEN b > 0 THEN 'explicit' END, CASE WHEN d > 0 THEN 'bidirectional' END, CASE WHEN s > 0 THEN 'semantic' END, CASE WHEN t > 0 THEN 'temporal' END], lambda x: x IS NOT NULL) AS evidence FROM (SELECT id, try_cast(j ->> '$.base_confidence' AS DOUBLE) AS b, try_cast(j ->> '$.bidirectional_boost' AS DOUBLE) AS d, try_cast(j ->> '$.semantic_boost' AS DOUBLE) AS s,
try_cast(j ->> '$.temporal_boost' AS DOUBLE) AS t FROM (SELECT id, try_cast(confidence_breakdown AS JSON) AS j FROM github_issue_pr_links))""")
def link_evidence(s, d):
    num = lambda p: F.get_json_object("confidence_breakdown", f"$.{p}").try_cast("double")
    t = table(s, d, "github_issue_pr_links", "id", "confidence_breakdown")
    return t.select("id", linking.evidence_of(num("base_confidence"), num("bidirectional_boost"), num("semantic_boost"), num("temporal_boost")).alias("evidence"))


_ROLE = "CASE WHEN user_login LIKE '%-dev' OR user_login LIKE '%-eng' THEN 'bot' WHEN user_login = owner THEN 'owner' WHEN author_association = 'MEMBER' THEN 'collaborator' ELSE 'contributor' END"


@query(f"""WITH {_LAST}, x AS (SELECT i.id, {_ROLE} AS role FROM i JOIN github_repositories r ON r.id = i.repo_id WHERE user_login IS NOT NULL AND owner IS NOT NULL)
SELECT id, role, round(5e-1 + CASE role WHEN 'owner' THEN 1e-1 WHEN 'collaborator' THEN 8e-2 WHEN 'bot' THEN 5e-2 ELSE 3e-2 END, 6) AS confidence FROM x""")
def link_commenter_roles(s, d):
    r = table(s, d, "github_repositories", "id", "owner").select(F.col("id").alias("repo_id"), "owner").where("owner IS NOT NULL")
    i = issues(s, d, "author_association").join(r, "repo_id").where("user_login IS NOT NULL")
    who = F.when(F.col("author_association") == "MEMBER", F.array("user_login")).otherwise(F.array().cast("array<string>"))
    role = linking.commenter_role(F.col("user_login"), F.col("owner"), who, F.col("user_login").rlike("-(?:dev|eng)$"))
    return i.select("id", role.alias("role")).select("id", "role", F.round(linking.role_boosted(F.lit(0.5), F.col("role")), 6).alias("confidence"))


@query("""WITH x AS (SELECT id, lower(coalesce(message, '')) AS m, starts_with(coalesce(message, ''), 'Merge pull request') AS merge, files_changed AS n FROM github_commits WHERE files_changed IS NOT NULL)
SELECT id, round(CASE WHEN contains(m, '#' || n) OR contains(m, 'pr ' || n) OR contains(m, 'pr#' || n) OR contains(m, 'issue ' || n) OR contains(m, 'issue#' || n) THEN 8e-1 ELSE 8e-1 * 3e-1 END, 6) AS confidence FROM x WHERE NOT merge""")
def link_checked_references(s, d):
    """The count of files stands for the number that was read into a message."""
    t = table(s, d, "github_commits", "id", "message", "files_changed").where("files_changed IS NOT NULL")
    c = linking.checked_reference(F.col("message"), F.col("files_changed"), F.lit(0.8))
    return t.select("id", F.round(c, 6).alias("confidence")).where("confidence IS NOT NULL")


@query("""WITH x AS (SELECT DISTINCT issue_number, pr_number, repo_id, user_verified FROM github_issue_pr_links), e AS (SELECT repo_id, issue_number, pr_number FROM x WHERE user_verified), d AS (SELECT repo_id, issue_number, pr_number, max(final_confidence) AS c FROM github_issue_pr_links WHERE detection_method <> 'deep_link_finder' AND final_confidence IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT e.issue_number IS NOT NULL AS e, c FROM (SELECT *, 1 AS k FROM e) e FULL JOIN d USING (repo_id, issue_number, pr_number)) SELECT count(*) FILTER (e AND c IS NOT NULL) AS tp, count(*) FILTER (NOT e AND c >= 6e-1) AS fp, count(*) FILTER (c IS NULL) AS fn FROM j""".replace("e.issue_number IS NOT NULL AS e", "k IS NOT NULL AS e"))
def link_matcher_metrics(s, d):
    t = table(s, d, "github_issue_pr_links", "repo_id", "issue_number", "pr_number", "user_verified", "detection_method", "final_confidence").where("repo_id IS NOT NULL AND issue_number IS NOT NULL AND pr_number IS NOT NULL")
    found = t.where("detection_method != 'deep_link_finder' AND final_confidence IS NOT NULL").withColumnRenamed("final_confidence", "confidence")
    return linking.matcher_metrics(t.where("user_verified"), found, ["repo_id", "issue_number", "pr_number"]).select("tp", "fp", "fn")


@query("""WITH p AS (SELECT unnest(list_distinct(evidence_sources)) AS pattern, coalesce(user_verified, false) AS f, final_confidence AS c FROM github_issue_pr_links)
SELECT pattern, count(*) AS cases, count(*) FILTER (f) AS found, round(coalesce(avg(c) FILTER (f), 0), 6) AS confidence, round(count(*) FILTER (f) / count(*)::DOUBLE, 6) AS rate FROM p GROUP BY 1""")
def link_pattern_metrics(s, d):
    t = table(s, d, "github_issue_pr_links", "evidence_sources", "user_verified", "final_confidence")
    c = t.select(F.col("evidence_sources").alias("patterns"), F.coalesce("user_verified", F.lit(False)).alias("found"), F.col("final_confidence").alias("confidence"))
    return linking.pattern_metrics(c).select("pattern", "cases", "found", *r6("confidence", "rate"))


@query(f"""WITH {_LAST}, f AS (SELECT repo_id, issue_number, list_distinct(list(pr_number)) AS found FROM github_issue_pr_links WHERE final_confidence >= 85e-2 AND pr_number IS NOT NULL GROUP BY 1, 2), e AS (SELECT repo_id, issue_number, list_distinct(list(pr_number)) AS expected FROM github_issue_pr_links WHERE user_verified AND pr_number IS NOT NULL GROUP BY 1, 2)
SELECT e.repo_id, e.issue_number, CASE WHEN list_has_any(expected, coalesce(found, [])) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM e LEFT JOIN f USING (repo_id, issue_number)""")
def link_case_verdicts(s, d):
    t = table(s, d, "github_issue_pr_links", "repo_id", "issue_number", "pr_number", "user_verified", "final_confidence").where("pr_number IS NOT NULL AND repo_id IS NOT NULL AND issue_number IS NOT NULL")
    e = t.where("user_verified").groupBy("repo_id", "issue_number").agg(F.collect_set("pr_number").alias("expected"))
    f = t.where("final_confidence >= 0.85").groupBy("repo_id", "issue_number").agg(F.collect_set("pr_number").alias("found"))
    none = F.array().cast("array<string>")
    return e.join(f, ["repo_id", "issue_number"], "left").select("repo_id", "issue_number", linking.case_verdict(F.col("expected"), none, F.col("found"), none, F.lit(False)).alias("verdict"))


@query("""WITH x AS (SELECT id, coalesce(try_cast(try_cast(semantic_analysis AS JSON) ->> '$.title_score' AS DOUBLE), 0) AS t, final_confidence AS c FROM github_issue_pr_links) SELECT id, round(coalesce(c, 0) * 3e-1 + t * 15e-2, 6) AS score FROM x""")
def link_candidate_scores(s, d):
    t = table(s, d, "github_issue_pr_links", "id", "final_confidence", "semantic_analysis")
    none = F.lit(None).cast("double")
    c = t.select("id", F.col("final_confidence").alias("temporal"), none.alias("comment"), none.alias("body"), F.get_json_object("semantic_analysis", "$.title_score").try_cast("double").alias("title"), none.alias("file"))
    return summary.rank_candidates(c).select("id", *r6("score"))


@query(f"WITH {_LAST} SELECT id, repo_id, number FROM i WHERE state = 'closed' AND closed_at IS NOT NULL ORDER BY closed_at DESC, id LIMIT 100")
def link_closed_issues(s, d):
    """The hundred that were closed last."""
    return issues(s, d).where("state = 'closed' AND closed_at IS NOT NULL").orderBy(F.desc("closed_at"), "id").limit(100).select("id", "repo_id", "number")


@query(f"WITH {_LAST} SELECT id, repo_id FROM p WHERE created_at >= TIMESTAMP '2020-01-01' - INTERVAL 365 DAYS AND NOT EXISTS (SELECT 1 FROM c WHERE c.repo_id = p.repo_id AND c.sha = p.merge_commit_sha)")
def sync_pulls_without_commit(s, d):
    """Pull requests of a window of days that lack their children."""
    p = pulls(s, d).where(F.col("created_at") >= as_of("2020-01-01 00:00:00") - F.expr("INTERVAL 365 DAYS"))
    c = table(s, d, "github_commits", "repo_id", "sha").withColumnRenamed("sha", "merge_commit_sha")
    return tables.missing(p, c, ["repo_id", "merge_commit_sha"]).select("id", "repo_id")
