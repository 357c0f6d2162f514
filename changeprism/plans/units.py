"""Queries over code units and files: listings, histories, metrics and diff risk, each with its SQL.

Regions are repositories, suppliers units, order lines changes; a unit's file is its nation, its start line its balance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeprism.operators import coupling, incidents, ownership, risk, tables, units
from changeprism.plans.graph import unit_changes
from changeprism.plans.registry import Registry, as_of, r6
from changeprism.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
NOW = "2001-08-01 00:00:00"
UNIT = ("repo_id", "block")


def _units(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation", "n_nationkey", "n_regionkey", "n_name")
    u = table(s, d, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return u.select(F.concat(F.lit("r"), "n_regionkey").alias("repo_id"), F.col("s_suppkey").alias("block"), F.col("s_name").alias("name"), F.col("n_name").alias("file"), F.when(F.col("s_acctbal") > 5000, "class").otherwise("function").alias("kind"), F.floor("s_acctbal").cast("int").alias("start_line"))


def _changes(s: SparkSession, d: str) -> DataFrame:
    return unit_changes(s, d).select("repo_id", "block", "sha", "author", "at")


def _hits(s: SparkSession, d: str) -> DataFrame:
    return unit_changes(s, d).where("flag = 'R'").groupBy(*UNIT, F.col("sha").alias("issue")).agg(F.min("shipped").alias("at"))


def _files(s: SparkSession, d: str) -> DataFrame:
    return _changes(s, d).join(_units(s, d).select(*UNIT, "file"), list(UNIT)).select("repo_id", "file", "sha", "author", "at")


_U = """u AS (SELECT 'r' || n_regionkey AS repo_id, s_suppkey AS block, s_name AS name, n_name AS file, CASE WHEN s_acctbal > 5000 THEN 'class' ELSE 'function' END AS kind, floor(s_acctbal)::INT AS start_line FROM supplier JOIN nation ON n_nationkey = s_nationkey),
ch AS (SELECT u.repo_id, u.block, u.file, l_orderkey AS sha, o_custkey AS author, o_orderdate AS t_at, l_returnflag AS flag, l_shipdate AS shipped FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN u ON u.block = l_suppkey),
h AS (SELECT repo_id, block, sha AS issue, min(shipped) AS t_at FROM ch WHERE flag = 'R' GROUP BY 1, 2, 3)"""
_DAYS = "((epoch_us(TIMESTAMP '2001-08-01') - epoch_us({})) // 86400000000)::BIGINT"
_RISK = f"""{_U}, l AS (SELECT repo_id, block, arg_max(author, (t_at, sha, author)) AS last_modifier, max(t_at) AS last_at FROM ch GROUP BY 1, 2), n AS (SELECT repo_id, block, count(*) AS n FROM h GROUP BY 1, 2),
w AS (SELECT u.*, coalesce(n, 0) AS incidents, last_modifier, last_at, {_DAYS.format("last_at")} AS staleness_days FROM u LEFT JOIN l USING (repo_id, block) LEFT JOIN n USING (repo_id, block))"""


def _risk(s: SparkSession, d: str) -> DataFrame:
    return units.with_risk(_units(s, d), _changes(s, d), _hits(s, d), as_of(NOW))


@query(f"WITH {_RISK} SELECT repo_id, block, file, incidents, last_modifier, staleness_days FROM w")
def unit_risk_columns(s, d):
    return _risk(s, d).select("repo_id", "block", "file", "incidents", "last_modifier", "staleness_days")


@query(f"WITH {_U} SELECT block, name, start_line FROM u WHERE file = 'NATION_3'")
def unit_of_file(s, d):
    return units.of_file(_units(s, d), "NATION_3").select("block", "name", "start_line")


@query(f"WITH {_U} SELECT block, file FROM u WHERE starts_with(file, 'NATION_1')")
def unit_in_folder(s, d):
    return units.in_folder(_units(s, d), "NATION_1").select("block", "file")


@query(f"WITH {_U} SELECT block, name FROM u WHERE name IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000003', 'Supplier#000000007') AND file IN (SELECT 'NATION_' || i FROM range(20) t(i))")
def unit_of_names(s, d):
    return units.of_names(_units(s, d), [f"Supplier#00000000{i}" for i in (1, 2, 3, 7)], [f"NATION_{i}" for i in range(20)]).select("block", "name")


@query(f"WITH {_U}, r AS (SELECT *, CASE WHEN starts_with(lower(name), 'supplier#00000000') THEN 1 WHEN contains(lower(name), '0') THEN 2 END AS rank FROM u) SELECT block, name, rank FROM r WHERE starts_with(lower(name), 'supplier#00000000') ORDER BY rank, name, repo_id, block LIMIT 10")
def unit_lookup(s, d):
    """The first ten by rank and name."""
    return units.lookup(_units(s, d), "SUPPLIER#00000000").select("block", "name", "rank")


@query(f"WITH {_RISK}, t AS (SELECT repo_id, block, incidents FROM w WHERE incidents > 0 ORDER BY incidents DESC, repo_id, block LIMIT 20) SELECT * FROM t")
def incident_top_units(s, d):
    return _risk(s, d).where("incidents > 0").orderBy(F.desc("incidents"), *UNIT).limit(20).select(*UNIT, "incidents")


@query(f"WITH {_U}, i AS (SELECT o_orderkey AS number, o_orderpriority AS title, o_orderstatus AS state FROM orders WHERE o_totalprice > 100000) SELECT h.repo_id, h.block, h.issue, title, state FROM h LEFT JOIN i ON i.number = h.issue")
def incident_of_units(s, d):
    """Dear orders are the issues that are there; incidents of others stay without title."""
    o = table(s, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice").where("o_totalprice > 100000")
    i = o.crossJoin(F.broadcast(_units(s, d).select("repo_id").distinct())).select("repo_id", F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("state"))  # five regions
    return units.incidents_of_units(_hits(s, d), i).select("repo_id", "block", "issue", "title", "state")


@query(f"""WITH {_RISK}, e AS (SELECT repo_id, block, author, count(DISTINCT sha) AS c FROM ch GROUP BY 1, 2, 3), b AS (SELECT repo_id, block, max(c) * 100e0 / sum(c) AS k FROM e GROUP BY 1, 2), x AS (SELECT w.*, k, round(least(100e0, incidents * 10e0), 6) AS risk_score FROM w JOIN b USING (repo_id, block))
SELECT repo_id, count(*) AS units, count(*) FILTER (risk_score > 70) AS critical, count(*) FILTER (risk_score >= 40 AND risk_score <= 70) AS medium, count(*) FILTER (risk_score < 40) AS low, count(*) FILTER (staleness_days > 90) AS stale, count(*) FILTER (k >= 70) AS bus_warnings FROM x GROUP BY 1""")
def ownership_overview(s, d):
    """Ten points for each incident stand for the risk score."""
    c = _changes(s, d).withColumn("unit", F.struct(*UNIT))
    b = ownership.bus_factor(c.drop("block").withColumnRenamed("unit", "block")).select("block.repo_id", "block.block", "concentration")
    x = _risk(s, d).join(b, list(UNIT)).withColumn("risk_score", F.round(F.least(F.lit(100.0), F.col("incidents") * 10.0), 6))
    return units.ownership_overview(x)


@query(f"WITH {_U}, r AS (SELECT * FROM ch WHERE t_at >= TIMESTAMP '2001-06-01'), l AS (SELECT repo_id, block, arg_max(author, (t_at, sha, author)) AS m FROM r GROUP BY 1, 2) SELECT u.repo_id, u.block, coalesce(m, start_line) AS modifier FROM u LEFT JOIN l USING (repo_id, block)")
def ownership_last_or_first(s, d):
    """Changes of the last two months; else the creator, for whom the start line stands."""
    recent = _changes(s, d).where(F.col("at") >= as_of("2001-06-01 00:00:00"))
    return units.last_or_first_author(_units(s, d).withColumn("creator", F.col("start_line").cast("bigint")), recent)


@query(f"WITH {_U} SELECT repo_id, block, arg_min(author, (t_at, sha, author)) AS original_author, arg_max(author, (t_at, sha, author)) AS last_modifier FROM ch GROUP BY 1, 2")
def ownership_by_repository(s, d):
    return ownership.first_and_last_author(_changes(s, d), as_of(NOW), ("repo_id",)).select("repo_id", "block", "original_author", "last_modifier")


@query(f"WITH {_U}, e AS (SELECT repo_id, block, author, count(DISTINCT sha) AS edits FROM ch GROUP BY 1, 2, 3) SELECT repo_id, block, author, edits FROM e QUALIFY row_number() OVER (PARTITION BY repo_id, block ORDER BY edits DESC, author) <= 10")
def ownership_familiarity_by_repository(s, d):
    return ownership.familiarity(_changes(s, d), 10, ("repo_id",)).select("repo_id", "block", "author", "edits")


@query("SELECT repo_id, author_email AS email, author_name AS name, count(*) AS commits, min(author_date) AS first_at, max(author_date) AS last_at FROM github_commits GROUP BY 1, 2, 3")
def ownership_roll_up(s, d):
    c = table(s, d, "github_commits", "repo_id", "author_email", "author_name", "author_date")
    return ownership.roll_up(c.toDF("repo_id", "email", "name", "at"))


@query(f"""WITH {_U}, n AS (SELECT repo_id, file, author, count(*) AS commits, max(t_at) AS last_at FROM ch GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT repo_id, file, author, commits, {_DAYS.format("last_at")} AS days, {_DAYS.format("last_at")} < 90 AS active FROM n QUALIFY row_number() OVER (PARTITION BY repo_id, file ORDER BY commits DESC, author) <= 10""")
def ownership_history(s, d):
    return units.ownership_history(_files(s, d), as_of(NOW), 90).select("repo_id", "file", "author", "commits", "days", "active")


@query(f"WITH {_U} SELECT DISTINCT repo_id, block, sha, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, block ORDER BY t_at DESC, sha)::INT AS rank FROM (SELECT DISTINCT repo_id, block, sha, t_at FROM ch)) WHERE rank <= 5")
def unit_recent_changes(s, d):
    return units.recent_changes(_changes(s, d).select("repo_id", "block", "sha", "at").distinct(), list(UNIT)).select("repo_id", "block", "sha", "rank")


@query(f"""WITH {_U}, x AS (SELECT DISTINCT repo_id, file, sha, t_at FROM ch), r AS (SELECT x.*, (sha % 90)::INT AS lines, row_number() OVER (PARTITION BY repo_id, file ORDER BY t_at DESC, sha) AS rank FROM x), a AS (SELECT repo_id, file, max(lines) FILTER (rank = 1) AS newest, sum(lines) AS lines FROM r WHERE rank <= 5 GROUP BY 1, 2),
c AS (SELECT repo_id, file, count(DISTINCT sha) AS commits FROM ch GROUP BY 1, 2), i AS (SELECT u.repo_id, u.file, count(*) AS n FROM h JOIN u USING (repo_id, block) GROUP BY 1, 2)
SELECT repo_id, file, round(least(1e0, coalesce(newest, 0) / 100e0), 6) AS complexity, round(coalesce(n, 0) * 100e0 / commits, 6) AS density, round(least(1e0, coalesce(lines, 0) / 500e0), 6) AS churn FROM c LEFT JOIN a USING (repo_id, file) LEFT JOIN i USING (repo_id, file)""")
def unit_collected_metrics(s, d):
    """The commit's number modulo 90 stands for the lines it added."""
    x = _files(s, d).select("repo_id", "file", "sha", "at").distinct()
    recent = units.recent_changes(x, ["repo_id", "file"]).withColumn("additions", (F.col("sha") % 90).cast("int")).withColumn("deletions", F.lit(0))
    hits = _hits(s, d).join(_units(s, d).select(*UNIT, "file"), list(UNIT))
    return units.collected_metrics(recent, x, hits).select("repo_id", "file", *r6("complexity", "density", "churn"))


@query(f"""WITH {_RISK}, x AS (SELECT repo_id, block, incidents AS c, incidents / 20e0 AS f, (1e0 + staleness_days) / 31 AS t FROM w) SELECT repo_id, block, CASE WHEN c <= 5 THEN 'LOW' WHEN c <= 10 THEN 'MEDIUM' ELSE 'HIGH' END AS coupling, CASE WHEN f <= 3e-1 THEN 'LOW' WHEN f <= 7e-1 THEN 'MEDIUM' ELSE 'HIGH' END AS cochange,
CASE WHEN t >= 8e-1 THEN 'LOW' WHEN t >= 3e-1 THEN 'MEDIUM' ELSE 'HIGH' END AS ratio, CASE WHEN c = 0 THEN 0 WHEN c <= 2 THEN 2e-1 WHEN c <= 5 THEN 5e-1 ELSE 8e-1 END AS frequency, CASE WHEN c > 10 OR f > 7e-1 OR t < 3e-1 THEN 'HIGH' WHEN c > 5 OR f > 3e-1 OR t < 8e-1 THEN 'MEDIUM' ELSE 'LOW' END AS overall,
CASE WHEN c >= 3 OR f > 8e-1 THEN 'HIGH' WHEN c >= 1 OR f > 5e-1 THEN 'MEDIUM' ELSE 'LOW' END AS baseline, round(least(1e0, CASE WHEN c > 15 THEN 3e-1 WHEN c > 10 THEN 15e-2 ELSE 0 END + (1 - t) * 3e-1 + f * 4e-1), 6) AS hotspot FROM x""")
def risk_metric_classes(s, d):
    """Incidents as a count, their twentieth as a frequency, staleness over a month as a ratio."""
    c, f, t = F.col("incidents"), F.col("incidents") / 20.0, (1.0 + F.col("staleness_days")) / 31
    return _risk(s, d).select(
        *UNIT, units.coupling_class(c).alias("coupling"), units.cochange_class(f).alias("cochange"), units.ratio_class(t).alias("ratio"), units.frequency_of_count(c).alias("frequency"), units.overall_risk(c, f, t).alias("overall"),
        units.baseline_risk(c, f).alias("baseline"), F.round(units.hotspot_score(c, t, f), 6).alias("hotspot"),
    )


@query(f"""WITH {_U}, g AS (SELECT repo_id, block, count(*) AS changes, min({_DAYS.format("t_at")}) AS days_since_last FROM ch WHERE {_DAYS.format("t_at")} BETWEEN 0 AND 90 GROUP BY 1, 2)
SELECT repo_id, block, changes, days_since_last, CASE WHEN changes > 10 THEN 'HIGH' WHEN changes > 5 AND days_since_last < 30 THEN 'HIGH' WHEN changes > 5 THEN 'MEDIUM' ELSE 'LOW' END AS class FROM g""")
def ownership_churn_classes(s, d):
    return units.churn_report(_changes(s, d), as_of(NOW))


@query("SELECT id, CASE WHEN coalesce(total_changes, 0) > 100 THEN 'LARGE' WHEN coalesce(total_changes, 0) > 30 THEN 'MEDIUM' ELSE 'SMALL' END AS size FROM github_commits")
def unit_change_sizes(s, d):
    return table(s, d, "github_commits", "id", "total_changes").select("id", units.change_size(F.coalesce("total_changes", F.lit(0))).alias("size"))


@query("""WITH e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'incident' WHEN 'click' THEN 'co_change' WHEN 'purchase' THEN 'ownership' ELSE 'none' END AS kind, least(value / 400, 1e0) AS s FROM events)
SELECT user_id, round(least(1e0, coalesce(avg(s) FILTER (kind = 'incident'), 0) * 5e-1 + coalesce(avg(s) FILTER (kind = 'co_change'), 0) * 3e-1 + coalesce(avg(s) FILTER (kind = 'ownership'), 0) * 2e-1), 6) AS score FROM e GROUP BY 1""")
def risk_evidence_scores(s, d):
    t = table(s, d, "events", "user_id", "event_type", "value")
    kind = F.when(F.col("event_type") == "error", "incident").when(F.col("event_type") == "click", "co_change").when(F.col("event_type") == "purchase", "ownership").otherwise("none")
    return units.evidence_score(t.select("user_id", kind.alias("kind"), F.least(F.col("value") / 400, F.lit(1.0)).alias("severity")), "user_id").select("user_id", *r6("score"))


_V = f"""{_U}, e AS (SELECT repo_id, block, block // 2 AS former FROM u WHERE block > 1), r AS (SELECT repo_id, block, former AS version, 1 AS hops FROM e UNION ALL SELECT r.repo_id, r.block, e.former, r.hops + 1 FROM r JOIN e ON r.version = e.block AND r.repo_id = e.repo_id WHERE r.hops < 5),
v AS (SELECT repo_id, block, block AS version FROM u UNION SELECT repo_id, block, version FROM r)"""


def _versions(s: SparkSession, d: str) -> DataFrame:
    """Half a unit's number is its former name, in its repository only."""
    u = _units(s, d)
    return units.versions(u.where("block > 1").select("repo_id", "block", F.expr("block div 2").alias("former")), u)


@query(f"""WITH RECURSIVE {_V}, j AS (SELECT v.repo_id, v.block, h.issue, v.version, max(h.t_at) AS t_at FROM v JOIN h ON h.repo_id = v.repo_id AND h.block = v.version GROUP BY 1, 2, 3, 4), t AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY repo_id, block ORDER BY t_at DESC, issue, version) <= 10)
SELECT repo_id, block, count(*) AS incidents, max(t_at) AS last_at, count(DISTINCT version) AS affected FROM t GROUP BY 1, 2""")
def risk_diff_incidents(s, d):
    return units.incident_risk(_versions(s, d), _hits(s, d))


@query(f"""WITH RECURSIVE {_V}, n AS (SELECT v.repo_id, v.block, author, count(*) AS n, max(t_at) AS last_at FROM v JOIN ch ON ch.repo_id = v.repo_id AND ch.block = v.version GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY repo_id, block ORDER BY n DESC, author) AS rank FROM n QUALIFY rank <= 10)
SELECT repo_id, block, arg_min(author, rank) AS most_active, arg_max(author, rank) AS least_active, count(*) AS contributors, {_DAYS.format("arg_min(last_at, rank)")} AS days, count(*) <= 2 AS few FROM t GROUP BY 1, 2""")
def risk_diff_ownership(s, d):
    return units.ownership_risk(_versions(s, d), _changes(s, d), as_of(NOW))


@query(f"WITH RECURSIVE {_V}, x AS (SELECT DISTINCT v.repo_id, v.block, v.version, sha, author, t_at FROM v JOIN ch ON ch.repo_id = v.repo_id AND ch.block = v.version) SELECT repo_id, block, version, sha, row_number() OVER (PARTITION BY repo_id, block ORDER BY t_at DESC, sha, version)::INT AS rank FROM x QUALIFY rank <= 20")
def risk_diff_history(s, d):
    return units.change_history(_versions(s, d), _changes(s, d)).select("repo_id", "block", "version", "sha", "rank")


_P = f"""{_U}, w AS (SELECT * FROM ch WHERE t_at >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAYS), o AS (SELECT DISTINCT repo_id, sha, block, t_at FROM w), q AS (SELECT x.repo_id, x.block AS a, y.block AS b, count(*) AS n, max(x.t_at) AS last_at FROM o x JOIN o y ON x.repo_id = y.repo_id AND x.sha = y.sha AND x.block < y.block GROUP BY 1, 2, 3),
t AS (SELECT repo_id, block, count(*) AS total FROM w GROUP BY 1, 2), pairs AS (SELECT q.repo_id, a, b, n, n / total::DOUBLE AS rate, last_at FROM q JOIN t ON t.repo_id = q.repo_id AND t.block = q.a WHERE n / total::DOUBLE >= 1e-2)"""


@query(f"WITH {_P} SELECT repo_id, a, b, n, round(rate, 6) AS rate FROM pairs")
def coupling_pairs_by_repository(s, d):
    return coupling.cochange_pairs(_changes(s, d), as_of(NOW), 365, 1, 0.01, by=("repo_id",)).select("repo_id", "a", "b", "n", *r6("rate"))


@query(f"""WITH {_P}, i AS (SELECT block, count(*) AS c FROM h GROUP BY 1), z AS (SELECT a AS block, b AS other, rate, last_at FROM pairs UNION ALL SELECT b, a, rate, last_at FROM pairs),
s AS (SELECT z.block, z.other, round(rate * (x.c + y.c) * CASE WHEN {_DAYS.format("last_at")} < 90 THEN 15e-1 WHEN {_DAYS.format("last_at")} < 180 THEN 1e0 ELSE 5e-1 END, 9) AS score FROM z JOIN i x ON x.block = z.block JOIN i y ON y.block = z.other WHERE rate >= 2e-2),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY block ORDER BY score DESC, other) <= 3) SELECT block, round(sum(score), 6) AS score, count(*) AS partners FROM k GROUP BY 1""")
def risk_diff_coupling(s, d):
    pairs = coupling.cochange_pairs(_changes(s, d), as_of(NOW), 365, 1, 0.01, by=("repo_id",)).select("a", "b", "rate", "last_at")
    n = _hits(s, d).groupBy("block").agg(F.count("*").alias("incidents"))
    return units.coupling_risk(pairs, n, as_of(NOW), 0.02).select("block", *r6("score"), "partners")


@query(f"""WITH {_RISK}, r AS (SELECT repo_id, block, round(incidents * 4e-1 + staleness_days / 365e0 * 3e-1, 9) AS raw FROM w) SELECT repo_id, block, round(CASE WHEN max(raw) OVER (PARTITION BY repo_id) > 0 THEN raw / max(raw) OVER (PARTITION BY repo_id) * 100e0 ELSE 0 END, 6) AS risk_score FROM r""")
def risk_composite_by_repository(s, d):
    """The greatest score of each repository is 100; all incidents count alike here."""
    b = _risk(s, d).select(*UNIT, "incidents", F.lit(None).cast("timestamp").alias("none"), "staleness_days").withColumn("last_at", as_of("2001-03-01 00:00:00").cast("timestamp"))
    b = b.withColumn("complexity", F.lit(1)).withColumn("couplings", F.lit(0)).withColumn("avg_rate", F.lit(0.0))
    return risk.composite_risk(b, as_of(NOW).cast("timestamp"), ["repo_id"]).select("repo_id", "block", *r6("risk_score"))


@query("SELECT repo_id, commit_sha, error_message, retry_count FROM dead_letter_queue WHERE retry_count < 5")
def queue_retries(s, d):
    return tables.retries(table(s, d, "dead_letter_queue", "repo_id", "commit_sha", "error_message", "retry_count"))


@query("SELECT id FROM dead_letter_queue WHERE updated_at >= TIMESTAMP '2020-01-01' OR updated_at IS NULL")
def queue_purged(s, d):
    return tables.purge(table(s, d, "dead_letter_queue", "id", "updated_at"), as_of("2020-01-01 00:00:00")).select("id")


@query("SELECT id FROM dead_letter_queue ORDER BY updated_at DESC NULLS LAST, id LIMIT 20")
def queue_recent(s, d):
    """The twenty that failed last."""
    return table(s, d, "dead_letter_queue", "id", "updated_at").orderBy(F.desc_nulls_last("updated_at"), "id").limit(20).select("id")


@query("""WITH f AS (SELECT repo_id, sha AS commit_sha, count(*) AS n FROM github_commits GROUP BY 1, 2), q AS (SELECT repo_id, commit_sha, max(retry_count) AS retry_count FROM dead_letter_queue WHERE commit_sha IS NOT NULL AND repo_id IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(q.repo_id, f.repo_id) AS repo_id, coalesce(q.commit_sha, f.commit_sha) AS commit_sha, (CASE WHEN q.commit_sha IS NOT NULL THEN coalesce(retry_count, 0) + coalesce(n, 0) ELSE n - 1 END)::INT AS retry_count FROM q FULL JOIN f ON f.repo_id = q.repo_id AND f.commit_sha = q.commit_sha""")
def queue_enqueued(s, d):
    """Every commit row taken for a failure."""
    q = table(s, d, "dead_letter_queue", "repo_id", "commit_sha", "error_message", "retry_count", "updated_at").where("commit_sha IS NOT NULL AND repo_id IS NOT NULL")
    q = q.groupBy("repo_id", "commit_sha").agg(F.max("error_message").alias("error_message"), F.coalesce(F.max("retry_count"), F.lit(0)).alias("retry_count"), F.max("updated_at").alias("updated_at"))
    f = table(s, d, "github_commits", "repo_id", "sha", "message", "fetched_at").toDF("repo_id", "commit_sha", "error_message", "at")
    return tables.enqueue_failures(q, f).select("repo_id", "commit_sha", "retry_count")


@query("SELECT event_type AS metric, count(*) AS uses, count(*) FILTER (value > 390) AS false_positives, count(*) FILTER (value > 390) / count(*)::DOUBLE <= 3e-2 AS enabled FROM events GROUP BY 1")
def queue_feedback(s, d):
    t = table(s, d, "events", "event_type", "value")
    return tables.feedback_rates(t.select(F.col("event_type").alias("metric"), (F.col("value") > 390).alias("false_positive"))).select("metric", "uses", "false_positives", "enabled")


@query("SELECT id, CASE WHEN id IN (SELECT id FROM github_commits WHERE processed_at IS NULL) THEN TIMESTAMP '2030-01-01' ELSE processed_at END AS processed_at FROM github_commits")
def sync_marked_processed(s, d):
    t = table(s, d, "github_commits", "id", "processed_at")
    return tables.mark_processed(t, t.where("processed_at IS NULL"), as_of("2030-01-01 00:00:00")).select("id", "processed_at")


@query("""WITH i AS (SELECT 'issues' AS e, count(*) AS n FROM github_issues UNION ALL SELECT 'pulls', count(*) FROM github_pull_requests UNION ALL SELECT 'commits', count(*) FROM github_commits UNION ALL SELECT 'developers', count(*) FROM github_developers) SELECT e AS entity, n AS rows FROM i""")
def sync_row_counts(s, d):
    names = {"issues": "github_issues", "pulls": "github_pull_requests", "commits": "github_commits", "developers": "github_developers"}
    out = None
    for e, t in names.items():
        row = table(s, d, t, "id").agg(F.count("*").alias("rows")).select(F.lit(e).alias("entity"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT repo_id, issue_number AS number FROM github_issue_pr_links EXCEPT SELECT repo_id, number FROM github_issues")
def sync_links_except_issues(s, d):
    l = table(s, d, "github_issue_pr_links", "repo_id", "issue_number").toDF("repo_id", "number")  # noqa: E741
    return l.subtract(table(s, d, "github_issues", "repo_id", "number"))


@query("WITH h AS (SELECT l_orderkey, l_suppkey AS block FROM lineitem WHERE l_returnflag = 'R') SELECT 'blocks' AS metric, count(DISTINCT block) * 100e0 / (SELECT count(*) FROM supplier) AS percent FROM h UNION ALL SELECT 'orders', round(count(DISTINCT l_orderkey) * 100e0 / (SELECT count(*) FROM orders), 6) FROM h")
def incident_coverage(s, d):
    h = table(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag").where("l_returnflag = 'R'")
    return incidents.coverage({"blocks": (h.select(F.col("l_suppkey").alias("k")), table(s, d, "supplier", "s_suppkey")), "orders": (h.select(F.col("l_orderkey").alias("k")), table(s, d, "orders", "o_orderkey"))}).select("metric", *r6("percent"))


_S = f"""{_U}, o AS (SELECT DISTINCT repo_id, sha, block FROM ch WHERE t_at >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAYS), q AS (SELECT x.repo_id, x.block, y.block AS other, count(*) AS n FROM o x JOIN o y ON x.repo_id = y.repo_id AND x.sha = y.sha AND x.block <> y.block GROUP BY 1, 2, 3),
t AS (SELECT repo_id, block, count(*) AS total FROM o GROUP BY 1, 2), s AS (SELECT q.repo_id, q.block, other, n, n / total::DOUBLE AS share FROM q JOIN t ON t.repo_id = q.repo_id AND t.block = q.block WHERE n / total::DOUBLE > 2e-2)"""


@query(f"WITH {_S} SELECT repo_id, block, other, n, round(share, 6) AS share, row_number() OVER (PARTITION BY repo_id, block ORDER BY share DESC, other)::INT AS rank FROM s QUALIFY rank <= 10")
def coupling_partner_shares(s, d):
    """A year and a fiftieth of the commits, as these tables are sparse."""
    return coupling.partner_shares(_changes(s, d), as_of(NOW), 365, 0.02, by=("repo_id",)).select("repo_id", "block", "other", "n", *r6("share"), "rank")


@query(f"WITH {_S} SELECT repo_id, block, count(*) AS partners FROM s GROUP BY 1, 2")
def coupling_partner_counts(s, d):
    return coupling.partner_counts(_changes(s, d), as_of(NOW), 365, 0.02, ("repo_id",))


@query(f"WITH {_RISK}, x AS (SELECT repo_id, block, incidents AS c, incidents / 20e0 AS f, (1e0 + staleness_days) / 31 AS t FROM w) SELECT repo_id, block, round(greatest(0e0, 1 - (1 - t) * 3e-1 - least(c / 20e0, 1e0) * 3e-1 - f * 2e-1), 6) AS reputation, CASE WHEN c > 10 THEN 8e0 WHEN c > 5 THEN 5e0 ELSE 2e0 END AS display FROM x")
def risk_reputation(s, d):
    c, f, t = F.col("incidents"), F.col("incidents") / 20.0, (1.0 + F.col("staleness_days")) / 31
    return _risk(s, d).select(*UNIT, F.round(units.reputation(c, t, f), 6).alias("reputation"), units.display_score(units.coupling_class(c)).alias("display"))


@query("SELECT p.id FROM github_pull_requests p WHERE EXISTS (SELECT 1 FROM github_repositories r WHERE r.id = p.repo_id AND r.default_branch = p.base_ref)")
def sync_default_branch(s, d):
    """Pull requests into the default branch of their repository."""
    r = table(s, d, "github_repositories", "id", "default_branch").toDF("repo_id", "base_ref")
    return tables.present(table(s, d, "github_pull_requests", "id", "repo_id", "base_ref"), r, ["repo_id", "base_ref"]).select("id")
