"""Queries of the property graph over commits, issues, pull requests and links, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeprism.operators import graph, linking, review, tables
from changeprism.plans.history import files_sql
from changeprism.plans.registry import Registry, as_of, r6
from changeprism.session import table
from changeprism.sources import gitlog

query = Registry()
QUERIES, SQL = query.queries, query.sql


def commits(s: SparkSession, d: str, *more: str) -> DataFrame:
    return tables.latest(table(s, d, "github_commits", "id", "repo_id", "sha", "author_name", "author_email", "author_date", "additions", "deletions", "fetched_at", *more), ["repo_id", "sha"])


def issues(s: SparkSession, d: str, *more: str) -> DataFrame:
    t = table(s, d, "github_issues", "id", "repo_id", "number", "title", "state", "user_login", "labels", "created_at", "closed_at", "fetched_at", *more)
    return tables.latest(t, ["repo_id", "number"])


def pulls(s: SparkSession, d: str, *more: str) -> DataFrame:
    t = table(s, d, "github_pull_requests", "id", "repo_id", "number", "title", "state", "user_login", "base_ref", "head_ref", "merge_commit_sha", "created_at", "merged_at", "fetched_at", *more)
    return tables.latest(t, ["repo_id", "number"])


def links(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "github_issue_pr_links", "id", "repo_id", "issue_number", "pr_number", "detection_method", "final_confidence", "confidence_breakdown", "evidence_sources")
    num = lambda p: F.get_json_object("confidence_breakdown", f"$.{p}").try_cast("double")
    return t.select(
        "id", "repo_id", "issue_number", "pr_number", F.col("final_confidence").alias("confidence"), F.col("detection_method").alias("method"), num("base_confidence").alias("base"), num("shared_pr_penalty").alias("penalty"),
        num("temporal_boost").alias("temporal"), num("bidirectional_boost").alias("bidirectional"), num("semantic_boost").alias("semantic"), F.col("evidence_sources").alias("tags"),
    )


_LAST = """c AS (SELECT * FROM github_commits QUALIFY row_number() OVER (PARTITION BY repo_id, sha ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1),
i AS (SELECT * FROM github_issues QUALIFY row_number() OVER (PARTITION BY repo_id, number ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1),
p AS (SELECT * FROM github_pull_requests QUALIFY row_number() OVER (PARTITION BY repo_id, number ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1)"""


def _plain(x: str) -> str:
    return f"CASE WHEN contains({x}, '@users.noreply.') AND length({x}) - length(replace({x}, '+', '')) = 1 THEN split_part({x}, '+', 2) ELSE {x} END"


_LOGIN = _plain("(user_login || '@users.noreply.github.com')")
_L = """l AS (SELECT id, repo_id, issue_number, pr_number, final_confidence AS confidence, detection_method AS method, evidence_sources AS tags, try_cast(try_cast(confidence_breakdown AS JSON) ->> '$.base_confidence' AS DOUBLE) AS base,
coalesce(try_cast(try_cast(confidence_breakdown AS JSON) ->> '$.shared_pr_penalty' AS DOUBLE), 0) AS penalty, coalesce(try_cast(try_cast(confidence_breakdown AS JSON) ->> '$.temporal_boost' AS DOUBLE), 0) AS temporal,
coalesce(try_cast(try_cast(confidence_breakdown AS JSON) ->> '$.bidirectional_boost' AS DOUBLE), 0) AS bidirectional, coalesce(try_cast(try_cast(confidence_breakdown AS JSON) ->> '$.semantic_boost' AS DOUBLE), 0) AS semantic FROM github_issue_pr_links)"""
_TYPE = """CASE WHEN coalesce(method IN ('github_timeline_verified', 'explicit_bidirectional'), false) AND coalesce(base, 0) >= 85e-2 AND penalty = 0 AND (temporal >= 12e-2 OR bidirectional > 0
OR (semantic >= 1e-1 AND coalesce(len(list_filter(tags, lambda t: contains(t, 'ref_fixes') OR contains(t, 'ref_closes') OR contains(t, 'ref_resolves'))) > 0, false))) THEN 'FIXED_BY' ELSE 'ASSOCIATED_WITH' END"""


@query(f"WITH {_LAST} SELECT repo_id || ':commit:' || sha AS id, repo_id, author_email, epoch_us(author_date) // 1000000 AS committed_at, additions, deletions FROM c WHERE sha IS NOT NULL AND repo_id IS NOT NULL")
def graph_commit_nodes(s, d):
    return graph.commit_nodes(commits(s, d)).select("id", "repo_id", "author_email", "committed_at", "additions", "deletions")


@query(f"""WITH {_LAST}, a AS (SELECT repo_id, {_plain("author_email")} AS email, author_name AS name, epoch_us(author_date) // 1000000 AS t FROM c UNION ALL SELECT repo_id, {_LOGIN}, user_login, epoch_us(created_at) // 1000000 FROM p)
SELECT repo_id || ':developer:' || email AS id, arg_max({{'n': name}}, (coalesce(t, -9e15), coalesce(name, ''))).n AS name, max(t) AS last_active FROM a WHERE email IS NOT NULL AND repo_id IS NOT NULL GROUP BY repo_id, email""")
def graph_developer_nodes(s, d):
    return graph.developer_nodes(commits(s, d), pulls(s, d)).select("id", "name", "last_active")


@query(f"WITH {_LAST} SELECT repo_id || ':pr:' || number AS id, title, state, base_ref AS base_branch, head_ref AS head_branch, {_LOGIN} AS author_email, merge_commit_sha, coalesce(epoch_us(merged_at) // 1000000, -1) AS merged_at FROM p WHERE repo_id IS NOT NULL AND number IS NOT NULL")
def graph_pull_nodes(s, d):
    return graph.pull_nodes(pulls(s, d)).select("id", "title", "state", "base_branch", "head_branch", "author_email", "merge_commit_sha", F.coalesce("merged_at", F.lit(-1)).alias("merged_at"))


@query(f"""WITH {_LAST}, x AS (SELECT repo_id || ':issue:' || number AS id, state, coalesce(from_json(TRY_CAST(labels AS JSON), '["VARCHAR"]'), []) AS labels, coalesce(epoch_us(closed_at) // 1000000, -1) AS closed_at FROM i WHERE repo_id IS NOT NULL AND number IS NOT NULL)
SELECT *, len(list_filter(labels, lambda v: v IN ('bug', 'Bug', 'defect', 'issue'))) > 0 AS bug FROM x""")
def graph_issue_nodes(s, d):
    return graph.issue_nodes(issues(s, d)).select("id", "state", "labels", F.coalesce("closed_at", F.lit(-1)).alias("closed_at"), graph.bug_labels(F.col("labels")).alias("bug"))


_TODAY = f"""{_LAST}, {files_sql("c")}, r AS (SELECT DISTINCT repo_id, o ->> '$.previous_filename' AS former, o ->> '$.filename' AS path FROM fo WHERE o ->> '$.previous_filename' <> o ->> '$.filename'),
cl AS (SELECT repo_id, former AS src, path AS dst FROM r UNION SELECT cl.repo_id, cl.src, r.path FROM cl JOIN r ON r.repo_id = cl.repo_id AND r.former = cl.dst),
k AS (SELECT repo_id, src AS filename, min(dst) AS canonical FROM cl WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.repo_id = cl.repo_id AND r.former = cl.dst) GROUP BY 1, 2),
ft AS (SELECT fo.repo_id, sha, o, o ->> '$.filename' AS filename, coalesce(canonical, o ->> '$.filename') AS path FROM fo LEFT JOIN k ON k.repo_id = fo.repo_id AND k.filename = o ->> '$.filename' WHERE sha IS NOT NULL)"""


@query(f"WITH RECURSIVE {_TODAY} SELECT repo_id || ':file:' || path AS id, repo_id, path, max((filename <> path)::INT) AS renamed FROM ft GROUP BY 1, 2, 3")
def graph_file_nodes(s, d):
    """Files of the commits' JSON in every shape, under their paths of today."""
    nodes, _ = _files(s, d)
    return nodes.select("id", "repo_id", "path", F.col("renamed").cast("int").alias("renamed"))


@query(f"""WITH RECURSIVE {_TODAY} SELECT repo_id || ':commit:' || sha AS src, repo_id || ':file:' || path AS dst, o ->> '$.status' AS status, coalesce(CASE WHEN json_type(o -> '$.additions') IN ('UBIGINT', 'BIGINT') THEN TRY_CAST(o ->> '$.additions' AS INT) END, -1) AS additions, coalesce(CASE WHEN json_type(o -> '$.deletions') IN ('UBIGINT', 'BIGINT') THEN TRY_CAST(o ->> '$.deletions' AS INT) END, -1) AS deletions FROM ft""")
def graph_modified_edges(s, d):
    _, edges = _files(s, d)
    return edges.select("src", "dst", "status", F.coalesce("additions", F.lit(-1)).alias("additions"), F.coalesce("deletions", F.lit(-1)).alias("deletions"))


def _files(s: SparkSession, d: str):
    files = gitlog.commit_files(commits(s, d, "raw_data"))
    renamed = gitlog.renames(commits(s, d, "raw_data"))
    return graph.file_graph(files, tables.identity_map(renamed).select("repo_id", F.explode("former").alias("path"), "canonical").groupBy("repo_id", "path").agg(F.min("canonical").alias("canonical")))


@query(f"""WITH {_LAST}, e AS (SELECT 'AUTHORED' AS type, repo_id || ':developer:' || {_plain("author_email")} AS src, repo_id || ':commit:' || sha AS dst FROM c
UNION ALL SELECT 'CREATED', repo_id || ':developer:' || {_LOGIN}, repo_id || ':issue:' || number FROM i UNION ALL SELECT 'CREATED', repo_id || ':developer:' || {_LOGIN}, repo_id || ':pr:' || number FROM p
UNION ALL SELECT 'MERGED_AS', repo_id || ':pr:' || number, repo_id || ':commit:' || lower(trim(merge_commit_sha)) FROM p WHERE trim(merge_commit_sha) <> '') SELECT * FROM e WHERE src IS NOT NULL AND dst IS NOT NULL""")
def graph_edges(s, d):
    return _edges(s, d).select("type", "src", "dst")


def _edges(s: SparkSession, d: str) -> DataFrame:
    i, p = issues(s, d), pulls(s, d)
    return graph.union([graph.authored_edges(commits(s, d)), graph.created_edges(i, "issue"), graph.created_edges(p, "pr"), graph.merged_edges(p)])


@query(f"""WITH {_LAST}, e AS (SELECT DISTINCT repo_id || ':pr:' || number AS src, repo_id || ':commit:' || lower(trim(merge_commit_sha)) AS dst FROM p WHERE trim(merge_commit_sha) <> '' AND repo_id IS NOT NULL),
n AS (SELECT repo_id || ':commit:' || sha AS id FROM c) SELECT 'MERGED_AS' AS type, count(*) AS asked, count(*) FILTER (dst IN (SELECT id FROM n)) AS created, count(*) FILTER (dst NOT IN (SELECT id FROM n WHERE id IS NOT NULL)) AS dropped FROM e""")
def graph_edge_sink(s, d):
    p = pulls(s, d)
    nodes = graph.commit_nodes(commits(s, d)).select("id").unionByName(graph.pull_nodes(p).select("id"))
    return graph.sink_counts(graph.merged_edges(p), nodes)


@query("""WITH n AS (SELECT 'Developer' AS label, repo_id || ':developer:' || email AS id, updated_at AS v, name FROM github_developers WHERE email IS NOT NULL) SELECT label, id, arg_max({'n': name}, (v, name)).n AS name, max(v) AS v FROM n GROUP BY 1, 2""")
def graph_node_sink(s, d):
    t = table(s, d, "github_developers", "repo_id", "email", "name", "updated_at").where("email IS NOT NULL")
    n = t.select(F.lit("Developer").alias("label"), graph.node_id(F.col("repo_id"), "developer", F.col("email")).alias("id"), F.col("updated_at").alias("v"), "name")
    return graph.merge_nodes(n, version="v")


@query(f"WITH {_LAST} SELECT id AS commit_id, repo_id, 'commit' AS kind, sha AS key FROM c WHERE sha IS NOT NULL AND repo_id IS NOT NULL")
def graph_split_ids(s, d):
    c = commits(s, d).where("sha IS NOT NULL AND repo_id IS NOT NULL")
    return c.select(F.col("id").alias("commit_id"), graph.split_id(graph.node_id(F.col("repo_id"), "commit", F.col("sha"))).alias("n")).select("commit_id", "n.*")


@query(f"""WITH {_L}, e AS (SELECT repo_id, issue_number, CASE WHEN method = 'github_timeline_verified' THEN 'cross-referenced' END AS event, pr_number FROM l)
SELECT 'REFERENCES' AS type, repo_id || ':issue:' || issue_number AS src, repo_id || ':pr:' || pr_number AS dst FROM e WHERE event = 'cross-referenced' AND pr_number IS NOT NULL
UNION ALL SELECT 'CLOSED_BY', l.repo_id || ':issue:' || issue_number, l.repo_id || ':commit:' || q.merge_commit_sha FROM l JOIN (SELECT * FROM github_pull_requests QUALIFY row_number() OVER (PARTITION BY repo_id, number ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1) q
ON q.repo_id = l.repo_id AND q.number = l.pr_number WHERE coalesce(list_contains(tags, 'ref_fixes'), false) AND q.merge_commit_sha IS NOT NULL""")
def graph_timeline_edges(s, d):
    t = links(s, d)
    refs = t.where("method = 'github_timeline_verified'").select("repo_id", "issue_number", F.lit("cross-referenced").alias("event"), F.lit("pr").alias("source_type"), F.col("pr_number").alias("source_number"), F.lit(None).cast("string").alias("source_sha"))
    fixes = t.where(F.array_contains("tags", "ref_fixes")).join(pulls(s, d).select("repo_id", F.col("number").alias("pr_number"), "merge_commit_sha"), ["repo_id", "pr_number"])
    done = fixes.select("repo_id", "issue_number", F.lit("closed").alias("event"), F.lit("commit").alias("source_type"), F.lit(None).cast("int").alias("source_number"), F.col("merge_commit_sha").alias("source_sha"))
    return graph.timeline_edges(refs.unionByName(done)).select("type", "src", "dst")


@query(f"WITH {_L} SELECT {_TYPE} AS type, repo_id || ':issue:' || issue_number AS src, repo_id || ':pr:' || pr_number AS dst, repo_id, confidence FROM l WHERE confidence >= 7e-1 UNION ALL SELECT 'MERGED_AS', repo_id || ':pr:' || number, repo_id || ':commit:' || lower(trim(merge_commit_sha)), repo_id, 1e0 FROM (SELECT * FROM github_pull_requests QUALIFY row_number() OVER (PARTITION BY repo_id, number ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1) WHERE trim(merge_commit_sha) <> '' AND repo_id IS NOT NULL")
def graph_link_edges(s, d):
    t = links(s, d)
    old = graph.link_edges(t.where("confidence >= 0.5"), None, 0.5).unionByName(graph.merged_edges(pulls(s, d)))
    return graph.link_edges(t, old)


@query(f"WITH {_L} SELECT id, CASE WHEN {_TYPE} = 'FIXED_BY' THEN 1 ELSE 0 END AS fixed FROM (SELECT * REPLACE (coalesce(base, 0) + 3e-1 AS base, 0 AS penalty) FROM l)")
def graph_link_types(s, d):
    """The type of each link with a base raised by 0.3 and no penalty, so that both types occur in these tables."""
    t = links(s, d)
    kind = graph.link_type(F.col("method"), F.coalesce("base", F.lit(0.0)) + 0.3, F.lit(0.0), *(F.col(c) for c in ("temporal", "bidirectional", "semantic", "tags")))
    return t.select("id", (kind == "FIXED_BY").cast("int").alias("fixed"))


@query("""WITH x AS (SELECT DISTINCT 'r' || n_regionkey AS repo_id, l_orderkey AS sha, l_suppkey AS block, l_returnflag AS f FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT DISTINCT CASE f WHEN 'A' THEN 'CREATED_BLOCK' WHEN 'N' THEN 'MODIFIED_BLOCK' WHEN 'R' THEN 'DELETED_BLOCK' END AS type, repo_id || ':commit:' || sha AS src, repo_id || ':block:' || block AS dst FROM x""")
def graph_change_edges(s, d):
    return graph.change_edges(unit_changes(s, d).withColumn("change_type", F.when(F.col("flag") == "A", "created").when(F.col("flag") == "N", "modified").when(F.col("flag") == "R", "deleted"))).select("type", "src", "dst")


def unit_changes(s: SparkSession, d: str) -> DataFrame:
    """Line items as changes (repo_id, sha, block, author, at, flag, shipped): regions are repositories, suppliers are units."""
    where = table(s, d, "supplier", "s_suppkey", "s_nationkey").join(table(s, d, "nation", "n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    line = table(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate").join(where, F.col("s_suppkey") == F.col("l_suppkey"))
    o = table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return line.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("r"), "n_regionkey").alias("repo_id"), F.col("l_orderkey").alias("sha"), F.col("l_suppkey").alias("block"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("shipped")
    )


@query(f"""WITH {_LAST}, l AS (SELECT repo_id, issue_number, pr_number FROM github_issue_pr_links WHERE issue_number IS NOT NULL AND pr_number IS NOT NULL)
SELECT l.repo_id || ':issue:' || issue_number AS src, l.repo_id || ':block:' || pr_number AS dst, count(*) AS n FROM l JOIN i ON i.repo_id = l.repo_id AND i.number = l.issue_number GROUP BY 1, 2""")
def graph_fixed_block_edges(s, d):
    t = table(s, d, "github_issue_pr_links", "repo_id", "issue_number", "pr_number").where("issue_number IS NOT NULL").withColumnRenamed("pr_number", "block").where("block IS NOT NULL")
    return graph.fixed_block_edges(t, issues(s, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"""WITH {_LAST}, r AS (SELECT repo_id, issue_number AS number FROM github_issue_pr_links UNION SELECT repo_id, pr_number FROM github_issue_pr_links)
SELECT repo_id, number, CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.repo_id = r.repo_id AND i.number = r.number) THEN 'issue' WHEN EXISTS (SELECT 1 FROM p WHERE p.repo_id = r.repo_id AND p.number = r.number) THEN 'pr' ELSE 'unknown' END AS kind FROM r""")
def graph_resolved_numbers(s, d):
    t = table(s, d, "github_issue_pr_links", "repo_id", "issue_number", "pr_number")
    r = t.select("repo_id", F.col("issue_number").alias("number")).unionByName(t.select("repo_id", F.col("pr_number").alias("number"))).distinct()
    return graph.resolve_numbers(r, issues(s, d), pulls(s, d))


@query(f"""WITH {_L}, e AS (SELECT id, repo_id || ':issue:' || issue_number AS src, repo_id || ':pr:' || pr_number AS dst, method FROM l) SELECT id FROM e WHERE method <> 'github_timeline_verified' AND src IS NOT NULL AND dst IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM e c WHERE c.method = 'github_timeline_verified' AND c.src = e.src AND c.dst = e.dst)""")
def graph_uncovered_links(s, d):
    t = links(s, d).select("id", "method", graph.node_id(F.col("repo_id"), "issue", F.col("issue_number")).alias("src"), graph.node_id(F.col("repo_id"), "pr", F.col("pr_number")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    sure = t.where("method = 'github_timeline_verified'").select(F.lit("REFERENCES").alias("type"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.without_covered(t.where("method != 'github_timeline_verified'"), sure).select("id")


@query(f"""WITH {_LAST}, {_L}, t AS (SELECT {_TYPE} AS type, * FROM l), j AS (SELECT t.repo_id, c.author_email AS path, issue_number, pr_number, p.merge_commit_sha AS sha, type, confidence, i.created_at
FROM t JOIN i ON i.repo_id = t.repo_id AND i.number = t.issue_number AND i.created_at > TIMESTAMP '2016-01-01' JOIN p ON p.repo_id = t.repo_id AND p.number = t.pr_number JOIN c ON c.repo_id = t.repo_id AND c.sha = p.merge_commit_sha)
SELECT DISTINCT repo_id, path, issue_number, pr_number, sha, type, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY confidence DESC NULLS LAST, created_at DESC, issue_number, pr_number, sha)::INT AS rank FROM j) WHERE rank <= 50""")
def graph_incident_history(s, d):
    """Issue, pull request, commit; the author's address stands for the file, which SQL cannot read from every shape of JSON."""
    t = links(s, d)
    kind = graph.link_type(*(F.col(c) for c in ("method", "base", "penalty", "temporal", "bidirectional", "semantic", "tags")))
    l = t.select("repo_id", "issue_number", "pr_number", kind.alias("type"), "confidence")  # noqa: E741
    merged = pulls(s, d).select("repo_id", F.col("number").alias("pr_number"), F.col("merge_commit_sha").alias("sha")).where("sha IS NOT NULL")
    modified = commits(s, d).select("repo_id", "sha", F.col("author_email").alias("path"))
    return graph.incident_history(l, issues(s, d), merged, modified, as_of("2016-01-01 00:00:00")).drop("title")


_USES = "u AS (SELECT DISTINCT p_brand AS dst, p_type || ' ' || (p_size // 10) AS src FROM part UNION SELECT p_type || ' ' || (p_size // 10), p_type FROM part)"


def _uses(s: SparkSession, d: str) -> DataFrame:
    """Types of parts use size classes of types, which use brands."""
    t = table(s, d, "part", "p_brand", "p_type", "p_size")
    mid = F.concat_ws(" ", "p_type", F.expr("p_size div 10").cast("string"))
    return t.select(mid.alias("src"), F.col("p_brand").alias("dst")).unionByName(t.select(F.col("p_type").alias("src"), mid.alias("dst"))).distinct()


@query(f"WITH {_USES}, r AS (SELECT src, dst FROM u UNION SELECT a.src, b.dst FROM u a JOIN u b ON a.dst = b.src) SELECT dst AS file, count(DISTINCT src) AS dependents, list_sort(list(DISTINCT src))[1:10] AS sample FROM r WHERE src <> dst GROUP BY 1")
def graph_dependents(s, d):
    return graph.dependents(_uses(s, d), 2, 10)


@query(f"""WITH {_USES}, f AS (SELECT DISTINCT p_type AS path, l_orderkey AS issue, l_shipdate AS t, l_shipdate AS closed_at FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'),
n AS (SELECT path AS dependent, count(DISTINCT issue) AS incidents, max(closed_at) AS last_at FROM f WHERE t > TIMESTAMP '2001-02-02' GROUP BY 1), e AS (SELECT u.dst AS file, u.src AS dependent, coalesce(incidents, 0) AS incidents, last_at FROM u LEFT JOIN n ON n.dependent = u.src)
SELECT *, row_number() OVER (PARTITION BY file ORDER BY incidents DESC, dependent)::INT AS rank FROM e QUALIFY rank <= 20""")
def graph_blast_incidents(s, d):
    line = table(s, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_shipdate").where("l_returnflag = 'R'")
    f = line.join(table(s, d, "part", "p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_type").alias("path"), F.col("l_orderkey").alias("issue"), F.col("l_shipdate").alias("at"), F.col("l_shipdate").alias("closed_at"))
    return graph.blast_incidents(_uses(s, d), f, as_of("2001-02-02 00:00:00"))


@query(f"WITH {_USES}, b AS (SELECT src AS path, dst AS other FROM u UNION SELECT dst, src FROM u), g AS (SELECT DISTINCT p_type AS grp, p_brand AS path FROM part UNION SELECT DISTINCT p_type, p_type FROM part) SELECT grp, count(DISTINCT other) AS coupling FROM g LEFT JOIN b USING (path) GROUP BY 1")
def graph_structural_coupling(s, d):
    t = table(s, d, "part", "p_type", "p_brand")
    g = t.select(F.col("p_type").alias("grp"), F.col("p_brand").alias("path")).unionByName(t.select(F.col("p_type").alias("grp"), F.col("p_type").alias("path"))).distinct()
    return graph.structural_coupling(_uses(s, d), g)


@query(f"WITH {_USES}, r AS (SELECT src, dst FROM u UNION SELECT a.src, b.dst FROM u a JOIN u b ON a.dst = b.src), n AS (SELECT dst FROM u GROUP BY 1 HAVING count(DISTINCT src) > 0) SELECT DISTINCT r.dst AS file, r.src AS path FROM r JOIN n ON n.dst = r.src WHERE r.src <> r.dst")
def graph_critical_users(s, d):
    return graph.critical_users(_uses(s, d), 0)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS block, p_partkey // 2 AS former FROM part WHERE p_partkey > 1), r AS (SELECT block, former AS version, 1 AS hops FROM e UNION ALL SELECT r.block, e.former, r.hops + 1 FROM r JOIN e ON r.version = e.block WHERE r.hops < 5)
SELECT block, block AS version, 0 AS hops FROM (SELECT block FROM e UNION SELECT former FROM e) UNION ALL SELECT block, version, min(hops) FROM r GROUP BY 1, 2""")
def graph_rename_chains(s, d):
    e = table(s, d, "part", "p_partkey").where("p_partkey > 1").select(F.col("p_partkey").alias("block"), F.expr("p_partkey div 2").alias("former"))
    return graph.rename_chain(e)
