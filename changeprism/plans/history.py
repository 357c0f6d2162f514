"""Queries of the change-history operators over the tables, each with its SQL.

Orders stand for commits (customers for authors, suppliers and brands for code units) where a query needs dense
co-change; the project's own tables serve the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeprism.functions import diff, text
from changeprism.operators import coupling, incidents, linking, ownership, review, risk, summary, tables
from changeprism.session import shared_folder, table
from changeprism.sources.gitlog import commit_files
from changeprism.streaming import events as streams



def as_of(time: str = "2001-08-01 00:00:00"):
    """The time that a query takes for now."""
    return F.lit(time).cast("timestamp_ntz")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def _changes(s: SparkSession, d: str, unit: str = "l_suppkey") -> DataFrame:
    line = table(s, d, "lineitem", "l_orderkey", unit)
    commit = table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return line.join(commit, line.l_orderkey == commit.o_orderkey).select(F.col("l_orderkey").alias("sha"), F.col(unit).alias("block"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"))


def _hits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("block"), F.col("l_orderkey").alias("issue")).agg(F.min("l_shipdate").alias("at"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return coupling.cochange_pairs(_changes(s, d), as_of(), 365, 2, 0.02)


_CH = "WITH ch AS (SELECT l_orderkey AS sha, l_suppkey AS block, o_custkey AS author, o_orderdate AS t_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_PAIRS = (
    _CH
    + """, w AS (SELECT * FROM ch WHERE t_at >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAYS), o AS (SELECT DISTINCT sha, block, t_at FROM w),
q AS (SELECT x.block AS a, y.block AS b, count(DISTINCT x.sha) AS n, max(x.t_at) AS last_at, max(x.sha) AS last_sha FROM o x JOIN o y ON x.sha = y.sha AND x.block < y.block GROUP BY 1, 2),
t AS (SELECT block, count(*) AS total_a FROM w GROUP BY 1),
pairs AS (SELECT a, b, n, total_a, n / total_a::DOUBLE AS rate, last_at, last_sha FROM q JOIN t ON t.block = a WHERE n >= 2 AND n / total_a::DOUBLE >= 0.02)
"""
)


@query(_PAIRS + "SELECT a, b, n, total_a, round(rate, 6) AS rate, last_at, last_sha FROM pairs")
def coupling_cochange_pairs(s, d):
    return _pairs(s, d).select("a", "b", "n", "total_a", *r6("rate"), "last_at", "last_sha")


@query(_PAIRS + ", h AS (SELECT DISTINCT l_suppkey AS block FROM lineitem WHERE l_returnflag = 'R') SELECT a, b, n FROM pairs WHERE a IN (SELECT block FROM h) AND b IN (SELECT block FROM h)")
def coupling_cochange_with_incidents(s, d):
    return coupling.cochange_pairs(_changes(s, d), as_of(), 365, 2, 0.02, _hits(s, d)).select("a", "b", "n")


@query(_PAIRS + "SELECT count(*) AS total, round(min(rate), 6) AS min_rate, round(max(rate), 6) AS max_rate, round(avg(rate), 6) AS avg_rate, count(*) FILTER (rate >= 0.75) AS high, count(*) FILTER (rate >= 0.5 AND rate < 0.75) AS medium FROM pairs")
def coupling_statistics(s, d):
    return coupling.coupling_statistics(_pairs(s, d)).select("total", *r6("min_rate", "max_rate", "avg_rate"), "high", "medium")


_AGG = ", u AS (SELECT a AS block, count(*) AS c, avg(rate) AS r FROM pairs GROUP BY 1 UNION ALL SELECT b, count(*), avg(rate) FROM pairs GROUP BY 1), g AS (SELECT block, sum(c)::BIGINT AS couplings, avg(r) AS avg_rate FROM u GROUP BY 1)"


@query(_PAIRS + _AGG + "SELECT block, couplings, round(avg_rate, 6) AS avg_rate FROM g")
def coupling_aggregates(s, d):
    return coupling.coupling_aggregates(_pairs(s, d)).select("block", "couplings", *r6("avg_rate"))


@query(_PAIRS + _AGG + "SELECT block, couplings FROM g ORDER BY couplings DESC, round(avg_rate, 6) DESC, block LIMIT 20")
def coupling_top_blocks(s, d):
    return coupling.coupling_aggregates(_pairs(s, d)).orderBy(F.desc("couplings"), F.desc(F.round("avg_rate", 6)), "block").limit(20).select("block", "couplings")


@query(_PAIRS + ", x AS (SELECT a AS block, b AS other, n, rate FROM pairs UNION ALL SELECT b, a, n, rate FROM pairs) SELECT block, other, n, row_number() OVER (PARTITION BY block ORDER BY rate DESC, other)::INT AS rank FROM x QUALIFY rank <= 3")
def coupling_top_partners(s, d):
    return coupling.coupled_with(_pairs(s, d), 0.0, 3).select("block", "other", "n", "rank")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS sha, p_brand AS block FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT * FROM e WHERE sha IN (SELECT sha FROM e GROUP BY 1 HAVING count(*) >= 2)),
n AS (SELECT block, count(*) AS n FROM m GROUP BY 1), q AS (SELECT x.block AS a, y.block AS b, count(*) AS co_changes FROM m x JOIN m y ON x.sha = y.sha AND x.block < y.block GROUP BY 1, 2)
SELECT a, b, co_changes, round(co_changes / greatest(i.n, j.n)::DOUBLE, 6) AS frequency FROM q JOIN n i ON i.block = a JOIN n j ON j.block = b WHERE co_changes / greatest(i.n, j.n)::DOUBLE >= 0.1""")
def coupling_file_cochange(s, d):
    line, part = table(s, d, "lineitem", "l_orderkey", "l_partkey"), table(s, d, "part", "p_partkey", "p_brand")
    e = line.join(part, line.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("sha"), F.col("p_brand").alias("block"))
    return coupling.file_cochange(e, 0.1).select("a", "b", "co_changes", *r6("frequency"))


@query(_CH + "SELECT block, arg_min(author, (t_at, sha, author)) AS original_author, arg_max(author, (t_at, sha, author)) AS last_modifier, max(t_at) AS last_at, ((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(max(t_at))) // 86400000000)::BIGINT AS staleness_days FROM ch GROUP BY 1")
def ownership_first_last(s, d):
    return ownership.first_and_last_author(_changes(s, d), as_of())


@query(_CH + ", e AS (SELECT block, author, count(DISTINCT sha) AS edits FROM ch GROUP BY 1, 2) SELECT block, author, edits, row_number() OVER (PARTITION BY block ORDER BY edits DESC, author)::INT AS rank FROM e QUALIFY rank <= 10")
def ownership_familiarity(s, d):
    return ownership.familiarity(_changes(s, d))


@query(_CH + ", e AS (SELECT block, author, count(DISTINCT sha) AS commits FROM ch GROUP BY 1, 2) SELECT block, author, commits, round(commits / sum(commits) OVER (PARTITION BY block)::DOUBLE, 6) AS share FROM e QUALIFY row_number() OVER (PARTITION BY block ORDER BY commits DESC, author) <= 3")
def ownership_share(s, d):
    return ownership.ownership_share(_changes(s, d)).select("block", "author", "commits", *r6("share"))


@query(_CH + ", e AS (SELECT block, author, count(DISTINCT sha) AS c FROM ch GROUP BY 1, 2), g AS (SELECT block, arg_max(author, (c, author)) AS expert, max(c) * 100.0::DOUBLE / sum(c) AS k FROM e GROUP BY 1) SELECT block, expert, round(k, 6) AS concentration, CASE WHEN k >= 90 THEN 'CRITICAL' WHEN k >= 70 THEN 'HIGH' WHEN k >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM g")
def ownership_bus_factor(s, d):
    return ownership.bus_factor(_changes(s, d)).select("block", "expert", *r6("concentration"), "level")


@query(_CH + """, x AS (SELECT *, (epoch_us(TIMESTAMP '2001-08-01') - epoch_us(t_at)) // 86400000000 AS age FROM ch), n AS (SELECT block, author, count(*) FILTER (age <= 30) AS recent, count(*) FILTER (age > 30) AS older FROM x WHERE age BETWEEN 0 AND 90 GROUP BY 1, 2),
c AS (SELECT block, arg_max(author, (recent, author)) AS current_owner FROM n WHERE recent > 0 GROUP BY 1), p AS (SELECT n.block, arg_max(author, (older, author)) AS previous_owner FROM n LEFT JOIN c USING (block) WHERE older > 0 AND (current_owner IS NULL OR author <> current_owner) GROUP BY 1)
SELECT block, current_owner, previous_owner FROM c FULL JOIN p USING (block)""")
def ownership_churn(s, d):
    return ownership.churn(_changes(s, d), as_of())


@query(_CH + """, n AS (SELECT block, author, count(*) AS c FROM ch GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY c DESC, author) AS r FROM n),
two AS (SELECT block, max(author) FILTER (r = 1) AS first_author, max(author) FILTER (r = 2) AS second_author FROM r WHERE r <= 2 GROUP BY 1),
e AS (SELECT ch.block, t_at, sum((author = first_author)::INT) OVER w AS x, sum((author = second_author)::INT) OVER w AS y FROM ch JOIN two USING (block) WHERE second_author IS NOT NULL AND author IN (first_author, second_author) WINDOW w AS (PARTITION BY ch.block ORDER BY t_at, (author <> first_author)::INT, sha ROWS UNBOUNDED PRECEDING))
SELECT block, first_author, second_author, t AS transition_at FROM two LEFT JOIN (SELECT block, min(t_at) FILTER (x > y) AS t FROM e GROUP BY 1) USING (block)""")
def ownership_transition(s, d):
    return ownership.transition(_changes(s, d))


@query("SELECT lower(author_email) AS email, arg_min(author_name, (author_date, sha)) FILTER (author_name IS NOT NULL) AS name, count(*) AS commits, min(author_date) AS first_at, max(author_date) AS last_at FROM github_commits WHERE author_email IS NOT NULL AND author_name IS NOT NULL GROUP BY 1")
def ownership_developers(s, d):
    c = table(s, d, "github_commits", "sha", "author_name", "author_email", "author_date").where("author_name IS NOT NULL")
    return ownership.developers(c.select("sha", F.col("author_name").alias("name"), F.col("author_email").alias("email"), F.col("author_date").alias("at")))


@query("SELECT repo_id, count(*) AS rows, count(email) AS emails, count(name) AS names, count(github_login) AS logins FROM github_developers GROUP BY 1")
def ownership_completeness(s, d):
    t = table(s, d, "github_developers", "repo_id", "email", "name", "github_login")
    return t.groupBy("repo_id").agg(F.count("*").alias("rows"), F.count("email").alias("emails"), F.count("name").alias("names"), F.count("github_login").alias("logins"))


_HITS = "h AS (SELECT l_suppkey AS block, l_orderkey AS issue, min(l_shipdate) AS t_at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"


@query("WITH " + _HITS + ", b AS (SELECT DISTINCT l_suppkey AS block FROM lineitem) SELECT b.block, count(h.issue) AS incidents, max(h.t_at) AS last_at FROM b LEFT JOIN h USING (block) GROUP BY 1")
def incident_counts(s, d):
    return incidents.incident_counts(table(s, d, "lineitem", "l_suppkey").withColumnRenamed("l_suppkey", "block"), _hits(s, d))


@query("WITH " + _HITS + ", n AS (SELECT block, count(*) AS n FROM h GROUP BY 1) SELECT count(DISTINCT block) AS blocks, count(DISTINCT issue) AS issues, count(*) AS links, round(avg(n), 6) AS avg_incidents, max(n) AS max_incidents FROM h JOIN n USING (block)")
def incident_statistics(s, d):
    return incidents.incident_statistics(_hits(s, d)).select("blocks", "issues", "links", *r6("avg_incidents"), "max_incidents")


@query("WITH e AS (SELECT o_orderkey AS issue, o_orderkey AS sha, o_orderdate AS t_at FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT DISTINCT l_suppkey AS block, l_orderkey AS sha FROM lineitem) SELECT block, issue, arg_min(e.sha, (t_at, e.sha)) AS sha, min(t_at) AS event_at FROM e JOIN c USING (sha) GROUP BY 1, 2")
def incident_links(s, d):
    e = table(s, d, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("issue"), F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("at"))
    return incidents.link_incidents(e, table(s, d, "lineitem", "l_suppkey", "l_orderkey").toDF("block", "sha")).withColumnRenamed("at", "event_at")


@query("""WITH l AS (SELECT id, TRY_CAST(labels AS JSON) AS j FROM github_issues), x AS (SELECT id, coalesce(from_json(j, '["VARCHAR"]'), []) AS a FROM l),
y AS (SELECT id, a, lower(list_filter(a, lambda v: contains(lower(v), 'bug') OR contains(lower(v), 'security') OR contains(lower(v), 'critical'))[1]) AS h FROM x)
SELECT id, coalesce(CASE WHEN contains(h, 'bug') THEN 'bug' WHEN contains(h, 'security') THEN 'security' WHEN contains(h, 'critical') THEN 'critical' END, a[1], 'unknown') AS incident_type FROM y""")
def incident_types(s, d):
    t = table(s, d, "github_issues", "id", "labels")
    return t.select("id", incidents.incident_type(F.coalesce(F.from_json("labels", "array<string>"), F.array().cast("array<string>"))).alias("incident_type"))


@query("SELECT repo_id, count(*) AS closed, round(avg((epoch_us(closed_at) - epoch_us(created_at)) / 3.6e9), 6) AS mean_hours FROM github_issues WHERE closed_at IS NOT NULL GROUP BY 1")
def incident_repair_hours(s, d):
    return incidents.repair_hours(table(s, d, "github_issues", "repo_id", "created_at", "closed_at"), "repo_id").select("repo_id", "closed", *r6("mean_hours"))


_BLOCKS = _PAIRS + _AGG + ", " + _HITS + """, b AS (SELECT block, arg_max(author, (t_at, sha, author)) AS m, ((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(max(t_at))) // 86400000000)::BIGINT AS staleness_days FROM ch GROUP BY 1),
i AS (SELECT block, count(*) AS n, max(t_at) AS last_at FROM h GROUP BY 1),
k AS (SELECT b.block, coalesce(i.n, 0) AS incidents, i.last_at, staleness_days, couplings, avg_rate FROM b LEFT JOIN i USING (block) LEFT JOIN g USING (block)),
raw AS (SELECT *, (CASE WHEN last_at IS NULL THEN 0e0 WHEN last_at > TIMESTAMP '2001-08-01' - INTERVAL 90 DAYS THEN incidents * 2e0 WHEN last_at > TIMESTAMP '2001-08-01' - INTERVAL 180 DAYS THEN incidents * 1e0 ELSE incidents * 5e-1 END) * 4e-1 + staleness_days / 365e0 * 3e-1 + coalesce(couplings, 0) * coalesce(avg_rate, 0e0) * 3e-1 AS raw FROM k),
scored AS (SELECT *, CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () * 100e0 ELSE 0e0 END AS risk_score FROM raw)
"""


def _blocks(s, d):
    ch = _changes(s, d)
    own = ownership.first_and_last_author(ch, as_of()).drop("last_at")
    inc = incidents.incident_counts(own.select("block"), _hits(s, d))
    agg = coupling.coupling_aggregates(_pairs(s, d))
    return own.join(inc, "block").join(agg, "block", "left").withColumn("complexity", F.lit(1))


@query(_BLOCKS + "SELECT block, incidents, couplings, staleness_days, round(risk_score, 6) AS risk_score FROM scored")
def risk_composite(s, d):
    return risk.composite_risk(_blocks(s, d), as_of()).select("block", "incidents", "couplings", "staleness_days", *r6("risk_score"))


@query(_BLOCKS + "SELECT block, round(risk_score, 6) AS risk_score FROM scored ORDER BY round(risk_score, 6) DESC, block LIMIT 50")
def risk_top_blocks(s, d):
    return risk.composite_risk(_blocks(s, d), as_of()).select("block", *r6("risk_score")).orderBy(F.desc("risk_score"), "block").limit(50)


@query(_BLOCKS + "SELECT block, round(incidents * 10e0 + coalesce(couplings * avg_rate, 0) * 2e0 + least(staleness_days / 30e0, 3e0) + CASE WHEN block % 7 = 0 THEN 2e0 ELSE 0e0 END + CASE WHEN staleness_days < 30 THEN (30e0 - staleness_days) / 30e0 * 5e0 ELSE 0e0 END, 6) AS score FROM k")
def risk_ranked(s, d):
    score = risk.ranked_risk(F.col("incidents"), F.coalesce(F.col("couplings") * F.col("avg_rate"), F.lit(0.0)), F.col("staleness_days"), F.col("block") % 7 == 0, True)
    return _blocks(s, d).select("block", F.round(score, 6).alias("score"))


@query(_BLOCKS + """, au AS (SELECT block, count(DISTINCT author) AS authors FROM ch GROUP BY 1), p AS (SELECT block, CASE WHEN incidents >= 5 THEN 40 WHEN incidents >= 3 THEN 30 WHEN incidents >= 1 THEN 15 ELSE 0 END + CASE WHEN staleness_days > 90 THEN 20 ELSE 0 END + CASE WHEN authors <= 2 THEN 10 ELSE 0 END
+ CASE WHEN coalesce(couplings * avg_rate, 0) > 10 THEN 30 WHEN coalesce(couplings * avg_rate, 0) > 5 THEN 20 WHEN coalesce(couplings * avg_rate, 0) > 0 THEN 10 ELSE 0 END AS points FROM k JOIN au USING (block))
SELECT block, points, CASE WHEN points >= 70 THEN 'CRITICAL' WHEN points >= 50 THEN 'HIGH' WHEN points >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM p""")
def risk_diff_level(s, d):
    authors = _changes(s, d).groupBy("block").agg(F.countDistinct("author").alias("authors"))
    score = F.coalesce(F.col("couplings") * F.col("avg_rate"), F.lit(0.0))
    p = risk.diff_points(F.col("incidents"), F.col("staleness_days") > 90, F.col("authors") <= 2, score)
    return _blocks(s, d).join(authors, "block").select("block", p.alias("points")).withColumn("level", risk.diff_level(F.col("points")))


@query(_BLOCKS + """, x AS (SELECT block, coalesce(couplings, 0) AS c, coalesce(avg_rate, 0) AS r, (1e0 + incidents) / (1 + staleness_days) AS t FROM k)
SELECT block, CASE WHEN c <= 5 THEN 'LOW' WHEN c <= 10 THEN 'MEDIUM' ELSE 'HIGH' END AS coupling_level, CASE WHEN t < 4e-1 THEN 'HIGH' WHEN t < 4e-1 + 3e-1 THEN 'MEDIUM' ELSE 'LOW' END AS ratio_level,
c > 10 OR r > 5e-1 OR t < 3e-1 OR (c = 0 AND r = 0 AND t = 0) OR c > 5 OR r > 4e-1 AS escalate FROM x""")
def risk_adaptive_levels(s, d):
    """Couplings, their mean rate, and incidents over staleness as a ratio, each in its own place."""
    c, r = F.coalesce("couplings", F.lit(0)), F.coalesce("avg_rate", F.lit(0.0))
    t = (1.0 + F.col("incidents")) / (1 + F.col("staleness_days"))
    return _blocks(s, d).select("block", risk.adaptive_level(c, F.lit(10)).alias("coupling_level"), risk.ratio_level(t, F.lit(0.4)).alias("ratio_level"), risk.escalate(c, r, t, 10, 0.5, 0.3).alias("escalate"))


def _near(s, d):
    us = lambda c: linking.micros(F.col(c)).alias("at")
    i = table(s, d, "github_issues", "id", "repo_id", "closed_at").select(F.col("repo_id").alias("key"), "id", us("closed_at"))
    p = table(s, d, "github_pull_requests", "id", "repo_id", "merged_at").select(F.col("repo_id").alias("key"), "id", us("merged_at"))
    return linking.within(i, p)


_NEAR = "WITH n AS (SELECT i.repo_id AS key, i.id AS left_id, p.id AS right_id, epoch_us(i.closed_at) - epoch_us(p.merged_at) AS delta_us FROM github_issues i JOIN github_pull_requests p ON i.repo_id = p.repo_id AND abs(epoch_us(i.closed_at) - epoch_us(p.merged_at)) < 86400000000)"


@query(_NEAR + "SELECT key, left_id, right_id, delta_us FROM n")
def link_within_day(s, d):
    return _near(s, d)


@query(_NEAR + "SELECT key, left_id, right_id, row_number() OVER (PARTITION BY key, left_id ORDER BY abs(delta_us), right_id)::INT AS rank FROM n QUALIFY rank <= 10")
def link_nearest_ten(s, d):
    return linking.nearest_k(_near(s, d), 10).select("key", "left_id", "right_id", "rank")


@query(_NEAR + "SELECT left_id, right_id, CASE WHEN abs(delta_us) < 300000000 THEN 75e-2 WHEN abs(delta_us) < 3600000000 THEN 65e-2 ELSE 55e-2 END AS confidence, CASE WHEN abs(delta_us) < 300000000 THEN 'simultaneous' WHEN delta_us < 0 THEN 'reverse' ELSE 'normal' END AS pattern FROM n")
def link_temporal_confidence(s, d):
    x = F.col("delta_us")
    return _near(s, d).select("left_id", "right_id", linking.temporal_confidence(x).alias("confidence"), linking.temporal_pattern(x).alias("pattern"))


@query("""WITH x AS (SELECT id, coalesce(final_confidence, 0e0) * 8e-1 AS base, coalesce(try_cast(try_cast(semantic_analysis AS JSON) ->> '$.title_score' AS DOUBLE), 0e0) AS sem, coalesce(try_cast(try_cast(temporal_analysis AS JSON) ->> '$.temporal_delta_seconds' AS DOUBLE), 1e6) AS dt FROM github_issue_pr_links),
y AS (SELECT id, round(least(98e-2, base + CASE WHEN sem >= 7e-1 THEN 15e-2 WHEN sem >= 5e-1 THEN 1e-1 WHEN sem >= 3e-1 THEN 5e-2 ELSE 0e0 END + CASE WHEN dt < 300 THEN 15e-2 WHEN dt < 3600 THEN 12e-2 WHEN dt < 86400 THEN 8e-2 WHEN dt < 259200 THEN 5e-2 ELSE 0e0 END), 6) AS confidence FROM x)
SELECT id, confidence, CASE WHEN confidence >= 85e-2 THEN 'high' WHEN confidence >= 7e-1 THEN 'medium' ELSE 'low' END AS quality FROM y""")
def link_final_confidence(s, d):
    t = table(s, d, "github_issue_pr_links", "id", "final_confidence", "semantic_analysis", "temporal_analysis")
    num = lambda c, p: F.get_json_object(c, p).try_cast("double")
    t = t.select("id", (F.coalesce("final_confidence", F.lit(0.0)) * 0.8).alias("base"), F.coalesce(num("semantic_analysis", "$.title_score"), F.lit(0.0)).alias("sem"), (F.coalesce(num("temporal_analysis", "$.temporal_delta_seconds"), F.lit(1e6)) * 1e6).alias("dt"))
    c = linking.final_confidence(F.col("base"), F.lit(0.0), linking.semantic_boost(F.col("sem")), linking.temporal_boost(F.col("dt")), F.lit(0.0))
    return t.select("id", F.round(c, 6).alias("confidence")).withColumn("quality", linking.quality(F.col("confidence")))


@query("""WITH g AS (SELECT repo_id, count(*) AS n, quantile_cont((epoch_us(merged_at) - epoch_us(created_at)) / 3.6e9, 0.5) AS m FROM github_pull_requests WHERE merged_at IS NOT NULL GROUP BY 1)
SELECT repo_id, n, round(m, 6) AS median_hours, n < 10 AS insufficient, CASE WHEN n < 10 THEN 90 WHEN m < 24 THEN 30 WHEN m < 72 THEN 45 WHEN m < 168 THEN 60 ELSE 90 END AS window_days, CASE WHEN n < 10 THEN 72 ELSE floor(greatest(36e0, least(m * 75e-2, 168e0)))::INT END AS link_hours FROM g""")
def link_lead_times(s, d):
    g = linking.lead_times(table(s, d, "github_pull_requests", "repo_id", "created_at", "merged_at"), ["repo_id"])
    return g.withColumn("link_hours", linking.link_window_hours(F.col("n"), F.col("median_hours"))).select("repo_id", "n", *r6("median_hours"), "insufficient", "window_days", "link_hours")


_TIERS = """WITH t AS (SELECT repo_id, count(*) FILTER (c >= 85e-2) AS high_n, coalesce(avg(c) FILTER (c >= 85e-2), 0) AS high_avg, count(*) FILTER (c >= 7e-1 AND c < 85e-2) AS medium_n, coalesce(avg(c) FILTER (c >= 7e-1 AND c < 85e-2), 0) AS medium_avg,
count(*) FILTER (c < 7e-1) AS low_n, coalesce(avg(c) FILTER (c < 7e-1), 0) AS low_avg FROM (SELECT repo_id, final_confidence AS c FROM github_issue_pr_links) GROUP BY 1)"""


@query(_TIERS + "SELECT repo_id, high_n, round(high_avg, 6) AS high_avg, medium_n, round(medium_avg, 6) AS medium_avg, low_n, round(low_avg, 6) AS low_avg, round(100e0 * coalesce((high_n * high_avg + medium_n * medium_avg * 7e-1 + low_n * low_avg * 3e-1) / nullif(high_n + medium_n * 7e-1 + low_n * 3e-1, 0), 0), 6) AS quality FROM t")
def link_confidence_tiers(s, d):
    t = table(s, d, "github_issue_pr_links", "repo_id", "final_confidence").withColumnRenamed("final_confidence", "confidence")
    q = linking.confidence_quality(linking.confidence_tiers(t, ["repo_id"]))
    return q.select("repo_id", "high_n", *r6("high_avg"), "medium_n", *r6("medium_avg"), "low_n", *r6("low_avg", "quality"))


@query("""WITH x AS (SELECT repo_id, issue_number, pr_number, max(final_confidence) AS c, bool_or(user_verified) AS e FROM github_issue_pr_links GROUP BY 1, 2, 3)
SELECT count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (e AND NOT f) AS fn, count(*) FILTER (NOT e AND NOT f) AS tn FROM (SELECT coalesce(e, false) AS e, coalesce(c >= 85e-2, false) AS f FROM x)""")
def link_backtest(s, d):
    """Links that a user verified are the truth, those of high confidence what was found."""
    t = table(s, d, "github_issue_pr_links", "repo_id", "issue_number", "pr_number", "final_confidence", "user_verified")
    g = t.groupBy("repo_id", "issue_number", "pr_number").agg(F.max("final_confidence").alias("c"), F.bool_or("user_verified").alias("e"))
    return linking.verdict_metrics(g.select(F.coalesce("e", F.lit(False)).alias("expected"), F.coalesce(F.col("c") >= 0.85, F.lit(False)).alias("found"))).select("tp", "fp", "fn", "tn")


@query("SELECT id, list_distinct(list_transform(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '(?:fix|fixes|fixed|close|closes|closed|resolve|resolves|resolved)\\s+#([0-9]{1,9})', 1), lambda v: v::INT)) AS refs FROM github_pull_requests WHERE regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '(?:fix|fixes|fixed|close|closes|closed|resolve|resolves|resolved)\\s+#[0-9]{1,9}')".replace("SELECT id, list_distinct", "SELECT id, list_sort(list_distinct").replace("v::INT)) AS refs", "v::INT))) AS refs"))
def text_issue_references(s, d):
    t = table(s, d, "github_pull_requests", "id", "title", "body")
    return t.select("id", F.array_sort(text.issue_references(F.col("title"), F.col("body"))).alias("refs")).where(F.size("refs") > 0)


@query("SELECT id, CASE WHEN contains(author_email, '@users.noreply.') AND length(author_email) - length(replace(author_email, '+', '')) = 1 THEN split_part(author_email, '+', 2) ELSE author_email END AS email FROM github_commits")
def text_plain_email(s, d):
    return table(s, d, "github_commits", "id", "author_email").select("id", text.plain_email(F.col("author_email")).alias("email"))


def files_sql(source: str) -> str:
    """Common table expressions d and fo of SQL: file objects (repo_id, sha, o) of the JSON of ``source``, strings of JSON read through."""
    some = "substr(ltrim(t.value ->> '$'), 1, 1) IN ('{', '[', '\"')"
    return f"""d AS (SELECT repo_id, sha, TRY_CAST(ltrim(raw_data, chr(65279)) AS JSON) AS j FROM {source} WHERE raw_data IS NOT NULL
UNION ALL SELECT d.repo_id, d.sha, TRY_CAST(t.value ->> '$' AS JSON) FROM d, json_tree(d.j) t WHERE t.type = 'VARCHAR' AND coalesce(t.key, '') <> 'patch' AND {some} AND TRY_CAST(t.value ->> '$' AS JSON) IS NOT NULL),
fo AS (SELECT d.repo_id, d.sha, t.value AS o FROM d, json_tree(d.j) t WHERE d.j IS NOT NULL AND t.type = 'OBJECT' AND t.value ->> '$.filename' IS NOT NULL)"""


_LANGUAGE = "coalesce(CASE lower(regexp_extract({}, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'java' THEN 'java' WHEN 'rb' THEN 'ruby' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'sh' THEN 'shell' WHEN 'md' THEN 'markdown' WHEN 'sql' THEN 'sql' END, 'unknown')"
_HEAD = "'^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@'"


def _number(i: int) -> str:
    return f"CASE WHEN regexp_extract(h, {_HEAD}, {i}) = '' THEN 1 ELSE TRY_CAST(regexp_extract(h, {_HEAD}, {i}) AS INT) END"


@query(f"""WITH RECURSIVE {files_sql("github_commits")}, l AS (SELECT repo_id, sha, o ->> '$.filename' AS filename, string_split(coalesce(o ->> '$.patch', ''), chr(10)) AS l FROM fo)
SELECT repo_id, sha, filename, len(list_filter(l, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS added, len(list_filter(l, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS removed FROM l""")
def diff_line_counts(s, d):
    """Added and removed lines of each patch."""
    f = commit_files(table(s, d, "github_commits", "repo_id", "sha", "raw_data"))
    plus, minus = diff.line_counts(F.col("patch"))
    return f.select("repo_id", "sha", "filename", plus.cast("bigint").alias("added"), minus.cast("bigint").alias("removed"))


@query(f"""WITH RECURSIVE {files_sql("github_commits")}, l AS (SELECT repo_id, sha, o ->> '$.filename' AS filename, unnest(string_split(coalesce(o ->> '$.patch', ''), chr(10))) AS h FROM fo)
SELECT repo_id, sha, filename, {_LANGUAGE.format("filename")} AS language, {_number(1)} AS old_start, {_number(2)} AS old_count, {_number(3)} AS new_start, {_number(4)} AS new_count FROM l WHERE regexp_matches(h, {_HEAD})""")
def diff_commit_hunks(s, d):
    f = commit_files(table(s, d, "github_commits", "repo_id", "sha", "raw_data"))
    return f.select("repo_id", "sha", "filename", text.language(F.col("filename")).alias("language"), F.explode(diff.hunks(F.col("patch"))).alias("h")).select("repo_id", "sha", "filename", "language", "h.*")


_KEYS = """list_sort(list_distinct(list_concat(k, list_transform(k, lambda w: CASE WHEN ends_with(w, 'ing') AND length(w) > 5 THEN left(w, -3) WHEN ends_with(w, 'ed') AND length(w) > 4 THEN left(w, -2) WHEN ends_with(w, 'es') AND length(w) > 4 THEN left(w, -2)
WHEN ends_with(w, 's') AND length(w) > 3 THEN left(w, -1) WHEN ends_with(w, 'er') AND length(w) > 4 THEN left(w, -2) WHEN ends_with(w, 'ly') AND length(w) > 4 THEN left(w, -2) ELSE w END))))"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _words(c: str) -> str:
    """SQL of the keywords of a text before stems are added."""
    clean = f"regexp_replace(regexp_replace(lower(coalesce({c}, '')), 'https?://[^\\s]+', '', 'g'), '\\*\\*|__|##|```', '', 'g')"
    return f"list_filter(regexp_extract_all({clean}, '([a-z0-9]+(?:[_-][a-z0-9]+)*)', 1), lambda w: w NOT IN ({_STOP}) AND length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+'))"


@query(f"""WITH x AS (SELECT id, {_words("title")} AS t, {_words("body")} AS b FROM github_issues), y AS (SELECT id, {_KEYS.replace("(k, ", "(t, ").replace("_transform(k", "_transform(t")} AS t, {_KEYS.replace("(k, ", "(b, ").replace("_transform(k", "_transform(b")} AS b FROM x)
SELECT id, t AS title_keywords, round(CASE WHEN len(t) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(t, b)) / len(list_distinct(list_concat(t, b)))::DOUBLE END, 6) AS similarity FROM y""")
def text_issue_keywords(s, d):
    t = table(s, d, "github_issues", "id", "title", "body")
    a, b = text.keywords(F.col("title")), text.keywords(F.col("body"))
    return t.select("id", a.alias("title_keywords"), F.round(text.jaccard(a, b), 6).alias("similarity"))


_LAST = "SELECT repo_id, number, arg_max(id, (fetched_at, id)) AS id, arg_max({'x': state}, (fetched_at, id)).x AS state FROM github_issues GROUP BY 1, 2"


@query(_LAST)
def sync_latest_issues(s, d):
    t = table(s, d, "github_issues", "repo_id", "number", "id", "state", "fetched_at")
    versioned = t.withColumn("version", F.struct("fetched_at", "id"))
    return tables.upsert_last(versioned.where("state = 'open'"), versioned.where("state IS NULL OR state != 'open'"), ["repo_id", "number"], "version").select("repo_id", "number", "id", "state")


@query("SELECT repo_id, issue_number, pr_number, max(final_confidence) AS final_confidence, arg_max({'x': detection_method}, (updated_at, final_confidence, id)).x AS detection_method FROM github_issue_pr_links WHERE final_confidence IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1, 2, 3")
def sync_links_keep_greatest(s, d):
    t = table(s, d, "github_issue_pr_links", "id", "repo_id", "issue_number", "pr_number", "final_confidence", "detection_method", "updated_at", "user_verified").where("final_confidence IS NOT NULL AND updated_at IS NOT NULL")
    t = t.withColumn("version", F.struct("updated_at", "final_confidence", "id"))
    done = F.coalesce("user_verified", F.lit(False))
    return tables.upsert_greatest(t.where(done).drop("user_verified"), t.where(~done).drop("user_verified"), ["repo_id", "issue_number", "pr_number"], "final_confidence", "version").select("repo_id", "issue_number", "pr_number", "final_confidence", "detection_method")


@query("SELECT id, repo_id FROM github_issues i WHERE NOT EXISTS (SELECT 1 FROM github_issue_pr_links l WHERE l.repo_id = i.repo_id AND l.issue_number = i.number)")
def sync_issues_without_link(s, d):
    i = table(s, d, "github_issues", "id", "repo_id", "number")
    l = table(s, d, "github_issue_pr_links", "repo_id", "issue_number").withColumnRenamed("issue_number", "number")  # noqa: E741
    return tables.missing(i, l, ["repo_id", "number"]).select("id", "repo_id")


@query("SELECT 'issues' AS entity, (SELECT count(*) FROM github_issues) AS source_rows, (SELECT count(*) FROM github_pull_requests) AS target_rows, round((SELECT count(*) FROM github_pull_requests) * 100e0 / (SELECT count(*) FROM github_issues), 6) AS percent, (SELECT count(*) FROM github_pull_requests) * 100e0 / (SELECT count(*) FROM github_issues) >= 95 AS ok")
def sync_consistency(s, d):
    return tables.consistency({"issues": (table(s, d, "github_issues", "id"), table(s, d, "github_pull_requests", "id"))}).select("entity", "source_rows", "target_rows", *r6("percent"), "ok")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1), r AS (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT r.src, e.dst, r.hops + 1 FROM r JOIN e ON r.dst = e.src WHERE r.hops < 3)
SELECT src, dst, min(hops) AS hops FROM r GROUP BY 1, 2""")
def graph_reach_three(s, d):
    e = table(s, d, "part", "p_partkey").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return tables.reach(e, 3)


@query("SELECT repo_id, number, 'MERGED_AS' AS type, lower(trim(merge_commit_sha)) AS dst FROM github_pull_requests WHERE merge_commit_sha IS NOT NULL AND trim(merge_commit_sha) <> ''")
def graph_merge_edges(s, d):
    t = table(s, d, "github_pull_requests", "repo_id", "number", "merge_commit_sha").where("merge_commit_sha IS NOT NULL AND trim(merge_commit_sha) <> ''")
    return t.select("repo_id", "number", F.lit("MERGED_AS").alias("type"), F.lower(F.trim("merge_commit_sha")).alias("dst"))


@query("SELECT count(*) AS total, count(*) FILTER (retry_count >= 5) AS exhausted, count(*) FILTER (retry_count < 5) AS waiting FROM dead_letter_queue")
def queue_statistics(s, d):
    t = table(s, d, "dead_letter_queue", "retry_count")
    return t.agg(F.count("*").alias("total"), F.count_if(F.col("retry_count") >= 5).alias("exhausted"), F.count_if(F.col("retry_count") < 5).alias("waiting"))


@query("SELECT id, sha FROM github_commits WHERE regexp_matches(message, '\\A(?i)[^\\n]*(fix|bug|hotfix|patch)[^\\n]*\\z') AND author_date >= TIMESTAMP '2020-01-01' - INTERVAL 180 DAYS ORDER BY author_date DESC, id LIMIT 10")
def incident_message_history(s, d):
    t = table(s, d, "github_commits", "id", "sha", "message", "author_date")
    return t.where(F.col("message").rlike(r"\A(?i)[^\n]*(fix|bug|hotfix|patch)[^\n]*\z") & coupling.in_window("author_date", as_of("2020-01-01 00:00:00"), 180)).orderBy(F.desc("author_date"), "id").limit(10).select("id", "sha")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly_counts(s, d):
    return streams.windowed_counts(table(s, d, "events", "ts", "event_type", "value")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _streamed(s: SparkSession, d: str, make, mode: str = "append") -> DataFrame:
    """The events table read as a stream of its files, through ``make`` into a table in the shared folder."""
    files = streams.read_table(s, f"{d}/events.parquet")
    return streams.run_once(make(files), f"{shared_folder(s)}/streams/{uuid.uuid4().hex}", mode)


@query("SELECT event_type, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def stream_new_rows(s, d):
    """Each row of the stream once, by type."""
    return _streamed(s, d, lambda e: e.where("value IS NOT NULL").select("event_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_states(s, d):
    """The windows of a real stream, the last state of each."""
    rows = _streamed(s, d, lambda e: streams.windowed_counts(e.select("ts", "event_type", "value")).withColumn("key", F.struct("start", "event_type")).select("key", "n"), "update")
    return streams.last_states(rows, "key").select(F.col("key.start").cast("timestamp_ntz").alias("start"), "key.event_type", "n")


@query("""WITH e AS (SELECT user_id AS unit, event_type = 'refund' AS gone, row_number() OVER w AS k, lag(event_type = 'refund', 1, true) OVER w AS absent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT unit::VARCHAR AS unit, CASE WHEN arg_max(gone, k) THEN 'absent' ELSE 'present' END AS state, count(*) FILTER (NOT (gone AND absent))::BIGINT AS changes FROM e GROUP BY 1""")
def stream_folded_units(s, d):
    """Users as units: a refund deletes, anything else modifies."""
    kind = F.when(F.col("event_type") == "refund", "DELETE").otherwise("MODIFY")
    make = lambda e: streams.fold_units(e.select(F.col("user_id").cast("string").alias("unit"), F.col("event_id").alias("seq"), kind.alias("behavior")))
    return streams.last_states(_streamed(s, d, make, "update"), "unit")


@query("SELECT date_trunc('minute', ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 2 * 9e-1")
def stream_throttled_minutes(s, d):
    return streams.throttle(table(s, d, "events", "ts", "value"), 2).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH w AS (SELECT ts - (k * INTERVAL 30 MINUTES) AS t FROM events, (VALUES (0), (1)) v(k)) SELECT to_timestamp(epoch_us(t) // 1800000000 * 1800)::TIMESTAMP AS start, count(*) AS n FROM w GROUP BY 1""")
def stream_sliding_hours(s, d):
    e = table(s, d, "events", "ts", "value").withColumn("event_type", F.lit("all"))
    return streams.windowed_counts(e, "1 hour", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def stream_sessions(s, d):
    return streams.sessions(table(s, d, "events", "ts", "user_id")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH m AS (SELECT id, string_split(coalesce(p.body, ''), chr(10)) AS l, coalesce(head_ref, '') || '.md' AS path FROM github_pull_requests p)
SELECT id, CASE WHEN len(list_filter(l, lambda x: trim(x) <> '')) = 0 THEN 'whitespace' WHEN len(list_filter(l, lambda x: NOT (trim(x) = '' OR regexp_matches(trim(x), '^(?://|#|\\*|/\\*|--)')))) = 0 THEN 'comment' WHEN path LIKE '%docs%' THEN 'documentation' WHEN len(l) < 10 THEN 'small_change' ELSE 'complex' END AS kind
FROM (SELECT id, l, CASE WHEN len(l) % 2 = 0 THEN 'docs/' || path ELSE 'src/a.py' END AS path FROM m)""")
def review_tier_zero(s, d):
    """Bodies of pull requests as changed lines; those of an even number of lines change a document."""
    t = table(s, d, "github_pull_requests", "id", "body", "head_ref").withColumn("l", F.split(F.coalesce("body", F.lit("")), "\n"))
    path = F.when(F.size("l") % 2 == 0, F.concat(F.lit("docs/"), F.coalesce("head_ref", F.lit("")), F.lit(".md"))).otherwise("src/a.py")
    return t.select("id", review.tier_zero(F.col("l"), F.array(path)).getField("kind").alias("kind"))


@query("""SELECT id FROM github_issues WHERE len(list_filter(string_split_regex(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda x: x = 'hangs')) + len(list_filter(string_split_regex(lower(coalesce(body, '')), '[^a-z0-9]+'), lambda x: x = 'hangs')) > 0
AND len(list_filter(string_split_regex(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda x: x = 'the')) + len(list_filter(string_split_regex(lower(coalesce(body, '')), '[^a-z0-9]+'), lambda x: x = 'the')) > 0
ORDER BY (len(list_filter(string_split_regex(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda x: x IN ('hangs', 'the'))) * 1e0 + len(list_filter(string_split_regex(lower(coalesce(body, '')), '[^a-z0-9]+'), lambda x: x IN ('hangs', 'the'))) * 4e-1) DESC, id LIMIT 10""")
def incident_search(s, d):
    t = table(s, d, "github_issues", "id", "title", "body")
    return review.search(t, "id", [("title", 1.0), ("body", 0.4)], "hangs the").select("id")


@query("SELECT id, sha FROM github_commits WHERE processed_at IS NULL ORDER BY author_date NULLS FIRST, id LIMIT 100")
def scan_unprocessed_commits(s, d):
    return review.unprocessed(table(s, d, "github_commits", "id", "sha", "author_date", "processed_at"), "author_date", 100).select("id", "sha")


@query("SELECT o_orderkey, len(l) AS n, l[1] AS first_part FROM (SELECT o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def scan_order_lines(s, d):
    o = table(s, d, "orders", "o_orderkey")
    l = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumnRenamed("l_orderkey", "o_orderkey")  # noqa: E741
    return review.with_children(o, l, ["o_orderkey"], ["l_linenumber", "l_partkey"], ["l_partkey"]).where("children IS NOT NULL").select("o_orderkey", F.size("children").cast("bigint").alias("n"), F.col("children")[0]["l_partkey"].alias("first_part"))


@query("""WITH RECURSIVE r AS (SELECT repo_id, issue_number AS issue, pr_number AS pr, final_confidence AS c, detection_method AS m, id AS seq FROM github_issue_pr_links WHERE final_confidence IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS k, first_value(m) OVER w AS m1 FROM r WINDOW w AS (PARTITION BY repo_id, issue, pr ORDER BY seq)),
f AS (SELECT repo_id, issue, pr, k, c::DOUBLE AS c, m AS method, m1, false AS both FROM o WHERE k = 1
UNION ALL SELECT o.repo_id, o.issue, o.pr, o.k, CASE WHEN f.both OR o.m IS DISTINCT FROM o.m1 THEN least(greatest(f.c, o.c) + 5e-2, 95e-2) ELSE greatest(f.c, o.c) END, CASE WHEN f.both OR o.m IS DISTINCT FROM o.m1 THEN 'bidirectional' ELSE f.method END, o.m1, f.both OR o.m IS DISTINCT FROM o.m1
FROM f JOIN o ON o.repo_id IS NOT DISTINCT FROM f.repo_id AND o.issue IS NOT DISTINCT FROM f.issue AND o.pr IS NOT DISTINCT FROM f.pr AND o.k = f.k + 1)
SELECT repo_id, issue, pr, round(arg_max(c, k), 6) AS confidence, arg_max({'m': method}, k).m AS method FROM f GROUP BY 1, 2, 3""")
def link_merged_references(s, d):
    t = table(s, d, "github_issue_pr_links", "id", "repo_id", "issue_number", "pr_number", "final_confidence", "detection_method").where("final_confidence IS NOT NULL")
    refs = t.select("repo_id", F.col("issue_number").alias("issue"), F.lit(None).cast("string").alias("sha"), F.col("pr_number").alias("pr"), F.col("final_confidence").alias("confidence"), F.col("detection_method").alias("method"), F.lit("mentions").alias("action"), F.col("id").alias("seq"))
    return review.merge_references(refs).select("repo_id", "issue", "pr", *r6("confidence"), "method")


@query("""SELECT repo_id, count(*) AS commits, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, max(author_date) AS last_at FROM github_commits WHERE author_date >= TIMESTAMP '2024-06-01' - INTERVAL 365 DAYS GROUP BY 1""")
def scan_recent_activity(s, d):
    t = table(s, d, "github_commits", "repo_id", "additions", "deletions", "author_date").where(coupling.in_window("author_date", as_of("2024-06-01 00:00:00"), 365))
    return t.groupBy("repo_id").agg(F.count("*").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.max("author_date").alias("last_at"))


@query("WITH m AS (SELECT p_brand AS canonical, p_name AS path FROM part UNION SELECT p_brand, p_brand FROM part), a AS (SELECT path, min((CASE WHEN path <> canonical THEN 1 ELSE 0 END) || canonical)[2:] AS canonical FROM m GROUP BY 1), q AS (SELECT p_name AS path FROM part UNION SELECT p_type FROM part UNION SELECT p_brand FROM part) SELECT path, coalesce(canonical, path) AS canonical FROM q LEFT JOIN a USING (path)")
def graph_canonical_paths(s, d):
    """Brands are files, names of their parts former paths; types are paths that no file had."""
    t = table(s, d, "part", "p_name", "p_brand", "p_type")
    former = t.groupBy(F.col("p_brand").alias("canonical")).agg(F.collect_set("p_name").alias("former"))
    paths = t.select(F.col("p_name").alias("path")).unionByName(t.select(F.col("p_type").alias("path"))).unionByName(t.select(F.col("p_brand").alias("path")))
    return tables.canonical_paths(former, paths)


@query(_BLOCKS + ", z AS (SELECT block, CASE WHEN block % 7 = 0 THEN 'class' ELSE 'function' END AS kind, incidents, couplings * avg_rate AS rate_sum, staleness_days FROM k WHERE incidents >= 1) SELECT block, kind, incidents, round(incidents * 10e0 + coalesce(rate_sum, 0) * 2e0 + least(staleness_days / 30e0, 3e0) + CASE WHEN kind = 'class' THEN 2e0 ELSE 0e0 END, 6) AS risk_score FROM z ORDER BY risk_score DESC, block LIMIT 10")
def risk_summary(s, d):
    b = _blocks(s, d).select("block", F.when(F.col("block") % 7 == 0, "class").otherwise("function").alias("kind"), "incidents", (F.col("couplings") * F.col("avg_rate")).alias("rate_sum"), "staleness_days")
    return summary.risk_summary(b, min_incidents=1).select("block", "kind", "incidents", "risk_score")


@query(_CH + ", " + _HITS + ", c AS (SELECT DISTINCT block, sha, t_at FROM ch) SELECT c.block, c.sha, coalesce(list_sort(list(DISTINCT h.issue) FILTER (h.issue IS NOT NULL)), []) AS issues FROM c LEFT JOIN h ON h.block = c.block AND abs(epoch_us(c.t_at) - epoch_us(h.t_at)) <= 7 * 86400000000 GROUP BY 1, 2")
def incident_unit_history(s, d):
    c = _changes(s, d).select("block", "sha", "at").distinct()
    return summary.unit_history(c, _hits(s, d)).select("block", "sha", "issues")


@query(_CH + ", m AS (SELECT DISTINCT sha FROM ch WHERE block IN (1, 2, 3)), n AS (SELECT block AS other, count(DISTINCT sha) AS n FROM ch WHERE block NOT IN (1, 2, 3) AND sha IN (SELECT sha FROM m) GROUP BY 1) SELECT other, n, round(n / (SELECT count(*) FROM m)::DOUBLE, 6) AS frequency FROM n WHERE n >= 3 OR n / (SELECT count(*) FROM m)::DOUBLE >= 3e-1 ORDER BY n DESC, other LIMIT 10")
def coupling_partners_of(s, d):
    return summary.partners(_changes(s, d), [1, 2, 3]).select("other", "n", *r6("frequency"))


@query("""WITH i AS (SELECT repo_id, CASE WHEN contains(labels, 'critical') THEN 'critical' WHEN contains(labels, 'p1') THEN 'high' ELSE 'low' END AS severity, created_at AS c, closed_at AS r FROM github_issues WHERE created_at IS NOT NULL)
SELECT repo_id, count(*) AS total, count(*) FILTER (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(c) <= 30 * 86400000000) AS last_30, count(*) FILTER (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(c) <= 90 * 86400000000) AS last_90,
count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, round(avg((epoch_us(r) - epoch_us(c)) / 1e6), 3) AS mean_seconds FROM i GROUP BY 1""")
def incident_file_statistics(s, d):
    t = table(s, d, "github_issues", "repo_id", "labels", "created_at", "closed_at").where("created_at IS NOT NULL")
    sev = F.when(F.col("labels").contains("critical"), "critical").when(F.col("labels").contains("p1"), "high").otherwise("low")
    i = t.select("repo_id", sev.alias("severity"), F.col("created_at").alias("at"), F.col("closed_at").alias("resolved_at"))
    return summary.file_statistics(i, "repo_id", as_of("2024-06-01 00:00:00")).select("repo_id", "total", "last_30", "last_90", "critical", "high", F.round("mean_seconds", 3).alias("mean_seconds"))


@query("""WITH k AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) ON l_partkey = p_partkey), w AS (SELECT DISTINCT p_name AS name, p_brand AS brand, p_type AS type FROM part),
a AS (SELECT name, brand, type, min(id) AS id FROM k GROUP BY 1, 2, 3), b AS (SELECT brand, type, min(id) AS id FROM k GROUP BY 1, 2), c AS (SELECT brand, min(id) AS id FROM k GROUP BY 1)
SELECT w.name, w.brand, w.type, coalesce(a.id, b.id, c.id)::VARCHAR AS id, CASE WHEN a.id IS NOT NULL THEN 0 WHEN b.id IS NOT NULL THEN 1 WHEN c.id IS NOT NULL THEN 2 END AS tier FROM w LEFT JOIN a USING (name, brand, type) LEFT JOIN b ON b.brand = w.brand AND b.type = w.type LEFT JOIN c ON c.brand = w.brand""")
def graph_match_by_tiers(s, d):
    """All parts against those of large returned items."""
    t = table(s, d, "part", "p_partkey", "p_name", "p_brand", "p_type").toDF("id", "name", "brand", "type")
    back = table(s, d, "lineitem", "l_partkey", "l_returnflag", "l_quantity").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return summary.match_by_tiers(t.select("name", "brand", "type").distinct(), t.join(back, "id", "left_semi"), [["name", "brand", "type"], ["brand", "type"], ["brand"]], "id", "new_function")


@query("""WITH y AS (SELECT repo_id, issue_number AS issue, pr_number AS candidate, max(final_confidence) AS score FROM github_issue_pr_links WHERE pr_number IS NOT NULL AND issue_number IS NOT NULL AND final_confidence IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, max(score) OVER (PARTITION BY repo_id, issue) AS best, row_number() OVER w AS rank FROM y WINDOW w AS (PARTITION BY repo_id, issue ORDER BY score DESC, candidate)),
k AS (SELECT *, best - lead(score) OVER (PARTITION BY repo_id, issue ORDER BY rank) AS gap FROM r WHERE score >= greatest(65e-2, best - 1e-1) AND rank <= 3 AND NOT (best < 70e-2))
SELECT repo_id, issue, candidate, rank::INT AS rank, round(least(85e-2, 5e-1 + 35e-2 * score), 6) AS confidence, CASE WHEN rank > 1 OR coalesce(gap, 1) < 3e-2 THEN 'low' ELSE 'medium' END AS quality FROM k""")
def link_selection(s, d):
    """All classes taken for uncertain, so that a best score under 0.70 gives no link."""
    t = table(s, d, "github_issue_pr_links", "repo_id", "issue_number", "pr_number", "final_confidence").where("pr_number IS NOT NULL AND issue_number IS NOT NULL AND final_confidence IS NOT NULL")
    y = t.groupBy("repo_id", F.col("issue_number").alias("issue"), F.col("pr_number").alias("candidate")).agg(F.max("final_confidence").alias("score"))
    return summary.select_links(y.withColumn("unsure", F.lit(True))).select("repo_id", "issue", "candidate", "rank", *r6("confidence"), "quality")


