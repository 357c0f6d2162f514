"""The property graph as two tables: nodes (label, id, repo_id, …) and edges (type, src, dst, repo_id, confidence).

Commits, developers, files, issues and pull requests become nodes and typed edges by projections and joins on natural
keys, for all repositories at once; identifiers are ``repository:kind:key``. Paths, hops and hop counts are equi joins.
Inputs are one row for each record (see ``tables.latest``). Null keys give no node and no edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeprism.functions import text
from changeprism.operators import linking
from changeprism.operators.tables import reach

#: Host of addresses made from a login, edge types of full confidence, methods and words of a verified link (fixed values).
NO_REPLY_HOST = "users.noreply.github.com"
CERTAIN_TYPES = ("MERGED_AS", "REFERENCES", "CLOSED_BY")
VERIFIED_METHODS = ("github_timeline_verified", "explicit_bidirectional")
FIX_TAGS = ("ref_fixes", "ref_closes", "ref_resolves")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def node_id(repo: Column, kind: str, key: Column) -> Column:
    """``repository:kind:key``; null for a null repository or key."""
    return F.concat(repo.cast("string"), F.lit(f":{kind}:"), key.cast("string"))


def split_id(node: Column) -> Column:
    """struct<repo_id, kind, key> of an identifier; an old ``kind:key`` one has a null repository."""
    p = F.split(node, ":", 3)
    old = F.split(node, ":", 2)
    whole = p[0].rlike("^[0-9]+$") & (F.size(p) == 3)
    return F.struct(F.when(whole, p[0].cast("bigint")).alias("repo_id"), F.when(whole, F.get(p, F.lit(1))).otherwise(old[0]).alias("kind"), F.when(whole, F.get(p, F.lit(2))).otherwise(F.get(old, F.lit(1))).alias("key"))


def epoch(c: str) -> Column:
    """Whole seconds since 1970."""
    return F.floor(linking.micros(F.col(c)) / F.lit(1_000_000)).cast("bigint")


def login_address(email: Column, login: Column) -> Column:
    """The address of an account: its own, else one made from its login."""
    return text.plain_email(F.coalesce(F.when(email != "", email), F.concat(login, F.lit(f"@{NO_REPLY_HOST}"))))


def commit_nodes(commits: DataFrame) -> DataFrame:
    """(label, id, repo_id, sha, author_email, committed_at, additions, deletions)."""
    return commits.where("sha IS NOT NULL AND repo_id IS NOT NULL").select(
        F.lit("Commit").alias("label"), node_id(F.col("repo_id"), "commit", F.col("sha")).alias("id"), "repo_id", "sha", "author_email", epoch("author_date").alias("committed_at"), "additions", "deletions"
    )


def developer_nodes(commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """(label, id, repo_id, email, name, last_active) of authors of commits and pull requests; the name last in use."""
    a = commits.select("repo_id", text.plain_email(F.col("author_email")).alias("email"), F.col("author_name").alias("name"), epoch("author_date").alias("at"))
    b = pulls.select("repo_id", login_address(F.lit(None).cast("string"), F.col("user_login")).alias("email"), F.col("user_login").alias("name"), epoch("created_at").alias("at"))
    g = a.unionByName(b).where("email IS NOT NULL AND repo_id IS NOT NULL").groupBy("repo_id", "email")
    g = g.agg(F.max_by("name", F.struct("at", "name")).alias("name"), F.max("at").alias("last_active"))
    return g.select(F.lit("Developer").alias("label"), node_id(F.col("repo_id"), "developer", F.col("email")).alias("id"), "repo_id", "email", "name", "last_active")


def pull_nodes(pulls: DataFrame) -> DataFrame:
    return pulls.where("number IS NOT NULL AND repo_id IS NOT NULL").select(
        F.lit("PR").alias("label"), node_id(F.col("repo_id"), "pr", F.col("number")).alias("id"), "repo_id", "number", "title", "state", F.col("base_ref").alias("base_branch"), F.col("head_ref").alias("head_branch"),
        login_address(F.lit(None).cast("string"), F.col("user_login")).alias("author_email"), "merge_commit_sha", epoch("created_at").alias("created_at"), epoch("merged_at").alias("merged_at"),
    )


def issue_nodes(issues: DataFrame) -> DataFrame:
    names = F.coalesce(F.from_json("labels", "array<string>"), F.array().cast("array<string>"))
    return issues.where("number IS NOT NULL AND repo_id IS NOT NULL").select(
        F.lit("Issue").alias("label"), node_id(F.col("repo_id"), "issue", F.col("number")).alias("id"), "repo_id", "number", "title", "state", names.alias("labels"), epoch("created_at").alias("created_at"), epoch("closed_at").alias("closed_at")
    )


def bug_labels(labels: Column) -> Column:
    return F.coalesce(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in ("bug", "Bug", "defect", "issue")])), F.lit(False))


def file_graph(files: DataFrame, identity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file nodes, MODIFIED edges) of (repo_id, sha, filename, status, additions, deletions); a former path of ``identity``
    (repo_id, path, canonical) is read as its file of today."""
    f = files.where("filename IS NOT NULL AND sha IS NOT NULL").join(identity.withColumnRenamed("path", "filename"), ["repo_id", "filename"], "left").withColumn("canonical", F.coalesce("canonical", "filename"))
    to = node_id(F.col("repo_id"), "file", F.col("canonical"))
    nodes = f.groupBy("repo_id", "canonical").agg(F.max((F.col("filename") != F.col("canonical")).cast("int")).alias("renamed"))
    nodes = nodes.select(F.lit("File").alias("label"), to.alias("id"), "repo_id", F.col("canonical").alias("path"), (F.col("renamed") == 1).alias("renamed"))
    edges = f.select(F.lit("MODIFIED").alias("type"), node_id(F.col("repo_id"), "commit", F.col("sha")).alias("src"), to.alias("dst"), "repo_id", "status", "additions", "deletions")
    return nodes, edges


def edge(kind: str, src: Column, dst: Column, confidence: Column) -> list[Column]:
    return [F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), F.col("repo_id"), confidence.alias("confidence")]


def authored_edges(commits: DataFrame) -> DataFrame:
    who = node_id(F.col("repo_id"), "developer", text.plain_email(F.col("author_email")))
    return commits.select(*edge("AUTHORED", who, node_id(F.col("repo_id"), "commit", F.col("sha")), F.lit(1.0))).where("src IS NOT NULL AND dst IS NOT NULL")


def created_edges(rows: DataFrame, kind: str) -> DataFrame:
    """Who opened an issue (kind issue) or pull request (pr)."""
    who = node_id(F.col("repo_id"), "developer", login_address(F.lit(None).cast("string"), F.col("user_login")))
    return rows.select(*edge("CREATED", who, node_id(F.col("repo_id"), kind, F.col("number")), F.lit(1.0))).where("src IS NOT NULL AND dst IS NOT NULL")


def merged_edges(pulls: DataFrame) -> DataFrame:
    p = pulls.where("trim(merge_commit_sha) != ''")
    return p.select(*edge("MERGED_AS", node_id(F.col("repo_id"), "pr", F.col("number")), node_id(F.col("repo_id"), "commit", F.lower(F.trim("merge_commit_sha"))), F.lit(1.0))).where("src IS NOT NULL")


def timeline_edges(events: DataFrame) -> DataFrame:
    """REFERENCES and CLOSED_BY of (repo_id, issue_number, event, source_type, source_number, source_sha); the source type of a
    pull request may be written pr or pull_request."""
    issue = node_id(F.col("repo_id"), "issue", F.col("issue_number"))
    refs = events.where("event = 'cross-referenced' AND source_type IN ('pull_request', 'pr') AND source_number IS NOT NULL")
    done = events.where("event = 'closed' AND source_sha IS NOT NULL")
    return union([
        refs.select(*edge("REFERENCES", issue, node_id(F.col("repo_id"), "pr", F.col("source_number")), F.lit(1.0))),
        done.select(*edge("CLOSED_BY", issue, node_id(F.col("repo_id"), "commit", F.col("source_sha")), F.lit(1.0))),
    ])


def link_type(method: Column, base: Column, penalty: Column, temporal: Column, bidirectional: Column, semantic: Column, tags: Column) -> Column:
    """FIXED_BY for a verified method, a sure base, no penalty and one more sign; else ASSOCIATED_WITH."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    words = F.coalesce(F.exists(tags, lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in FIX_TAGS])), F.lit(False))
    sign = (zero(temporal) >= 0.12) | (zero(bidirectional) > 0) | ((zero(semantic) >= 0.10) & words)
    return F.when(F.coalesce(method.isin(*VERIFIED_METHODS), F.lit(False)) & (zero(base) >= 0.85) & (zero(penalty) == 0) & sign, "FIXED_BY").otherwise("ASSOCIATED_WITH")


def link_edges(links: DataFrame, old: DataFrame | None = None, least: float = 0.7) -> DataFrame:
    """Edges of links of ``least`` confidence, which take the place of all ``old`` edges between issues and pull requests.

    ``links``: (repo_id, issue_number, pr_number, confidence, method, base, penalty, temporal, bidirectional, semantic, tags).
    """
    kind = link_type(*(F.col(c) for c in ("method", "base", "penalty", "temporal", "bidirectional", "semantic", "tags")))
    new = links.where(F.col("confidence") >= least).select(kind.alias("type"), node_id(F.col("repo_id"), "issue", F.col("issue_number")).alias("src"), node_id(F.col("repo_id"), "pr", F.col("pr_number")).alias("dst"), "repo_id", "confidence")
    if old is None:
        return new
    keep = ~(split_id(F.col("src"))["kind"].eqNullSafe("issue") & split_id(F.col("dst"))["kind"].eqNullSafe("pr"))
    return new.unionByName(old.where(keep).select(*new.columns))


def change_edges(changes: DataFrame) -> DataFrame:
    """Commit to unit: CREATED_BLOCK, MODIFIED_BLOCK or DELETED_BLOCK of (repo_id, sha, block, change_type)."""
    kind = F.when(F.col("change_type") == "created", "CREATED_BLOCK").when(F.col("change_type") == "deleted", "DELETED_BLOCK").when(F.col("change_type").isin("modified", "renamed"), "MODIFIED_BLOCK")
    return changes.select(kind.alias("type"), node_id(F.col("repo_id"), "commit", F.col("sha")).alias("src"), node_id(F.col("repo_id"), "block", F.col("block")).alias("dst"), "repo_id").where("type IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").distinct()


def fixed_block_edges(incidents: DataFrame, issues: DataFrame) -> DataFrame:
    """Issue to unit: (repo_id, issue_number, block, at) of incidents whose issue is there."""
    j = incidents.join(issues.select("repo_id", F.col("number").alias("issue_number")), ["repo_id", "issue_number"])
    return j.select(*edge("FIXED_BY_BLOCK", node_id(F.col("repo_id"), "issue", F.col("issue_number")), node_id(F.col("repo_id"), "block", F.col("block")), F.lit(1.0)))


def merge_nodes(nodes: DataFrame, keys: tuple[str, ...] = ("label", "id"), version: str | None = None) -> DataFrame:
    """One node for each key; of several the one of the greatest ``version``, else of the greatest values."""
    rest = sorted((c for c in nodes.columns if c not in keys), key=lambda c: c != version)
    return nodes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def attached_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges both ends of which are nodes."""
    ids = nodes.select("id").distinct()
    return edges.distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def sink_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(type, asked, created, dropped) of an edge sink that needs both ends."""
    asked = edges.distinct().groupBy("type").agg(F.count("*").alias("asked"))
    made = attached_edges(edges, nodes).groupBy("type").agg(F.count("*").alias("created"))
    return asked.join(made, "type", "left").select("type", "asked", F.coalesce("created", F.lit(0)).alias("created"), (F.col("asked") - F.coalesce("created", F.lit(0))).alias("dropped"))


def without_covered(weak: DataFrame, edges: DataFrame) -> DataFrame:
    """``weak`` edges (src, dst) but those whose ends a certain edge joins, in either direction."""
    pair = lambda: F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).alias("pair")
    sure = edges.where(F.col("type").isin(*CERTAIN_TYPES)).select(pair()).distinct()
    return weak.withColumn("pair", pair()).join(sure, "pair", "left_anti").drop("pair")


def resolve_numbers(references: DataFrame, issues: DataFrame, pulls: DataFrame) -> DataFrame:
    """(repo_id, number, kind) of (repo_id, number): an issue first, else a pull request, else unknown."""
    has = lambda df, n: df.select("repo_id", "number").distinct().withColumn(n, F.lit(True))
    j = references.join(has(issues, "i"), ["repo_id", "number"], "left").join(has(pulls, "p"), ["repo_id", "number"], "left")
    return j.withColumn("kind", F.when(F.col("i"), "issue").when(F.col("p"), "pr").otherwise("unknown")).drop("i", "p")


def incident_history(links: DataFrame, issues: DataFrame, commit_pulls: DataFrame, modified: DataFrame, since: Column, k: int = 50) -> DataFrame:
    """(repo_id, path, issue_number, pr_number, sha, type, confidence, title, rank): issue to pull request to commit to file, the
    ``k`` of greatest confidence of each file, the newest issue first.

    ``links``: (repo_id, issue_number, pr_number, type, confidence); ``commit_pulls``: (repo_id, sha, pr_number);
    ``modified``: (repo_id, sha, path).
    """
    i = issues.where(F.col("created_at") > since).select("repo_id", F.col("number").alias("issue_number"), "title", "created_at")
    j = links.join(i, ["repo_id", "issue_number"]).join(commit_pulls, ["repo_id", "pr_number"]).join(modified, ["repo_id", "sha"])
    w = Window.partitionBy("repo_id", "path").orderBy(F.desc("confidence"), F.desc("created_at"), "issue_number", "pr_number", "sha")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("repo_id", "path", "issue_number", "pr_number", "sha", "type", "confidence", "title", "rank")


def dependents(uses: DataFrame, hops: int, sample: int) -> DataFrame:
    """(file, dependents, sample): distinct files within ``hops`` of (src, dst) ``uses`` (src uses dst), with the first in order."""
    far = reach(uses, hops).where("src != dst")
    return far.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("dependents"), F.slice(F.array_sort(F.collect_set("src")), 1, sample).alias("sample"))


def blast_incidents(uses: DataFrame, file_incidents: DataFrame, since: Column, k: int = 20) -> DataFrame:
    """(file, dependent, incidents, last_at, rank): files that use a file, by distinct issues since then."""
    n = file_incidents.where(F.col("at") > since).groupBy(F.col("path").alias("dependent")).agg(F.countDistinct("issue").alias("incidents"), F.max("closed_at").alias("last_at"))
    e = uses.select(F.col("dst").alias("file"), F.col("src").alias("dependent")).distinct().join(n, "dependent", "left").withColumn("incidents", F.coalesce("incidents", F.lit(0)))
    w = Window.partitionBy("file").orderBy(F.desc("incidents"), "dependent")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("file", "dependent", "incidents", "last_at", "rank")


def structural_coupling(uses: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, coupling): distinct neighbours, in any direction, of all paths (grp, path) of a group."""
    both = uses.select(F.col("src").alias("path"), F.col("dst").alias("other")).unionByName(uses.select(F.col("dst").alias("path"), F.col("src").alias("other")))
    n = groups.join(both, "path").groupBy("grp").agg(F.countDistinct("other").alias("coupling"))
    return groups.select("grp").distinct().join(n, "grp", "left").select("grp", F.coalesce("coupling", F.lit(0)).alias("coupling"))


def critical_users(uses: DataFrame, least: int = 10, hops: int = 2) -> DataFrame:
    """(file, path): files within ``hops`` users of a file that more than ``least`` others use."""
    busy = uses.groupBy("dst").agg(F.countDistinct("src").alias("n")).where(F.col("n") > least).select(F.col("dst").alias("src"))
    return reach(uses, hops).where("src != dst").join(busy, "src", "left_semi").select(F.col("dst").alias("file"), F.col("src").alias("path"))


def rename_chain(renames: DataFrame, hops: int = 5) -> DataFrame:
    """(block, version, hops): each unit of (block, former) ``renames`` with itself (0 hops) and its former versions."""
    own = renames.select(F.col("block").alias("b")).union(renames.select("former")).distinct()
    back = reach(renames.select(F.col("block").alias("src"), F.col("former").alias("dst")), hops).select(F.col("src").alias("block"), F.col("dst").alias("version"), "hops")
    return own.select(F.col("b").alias("block"), F.col("b").alias("version"), F.lit(0).alias("hops")).unionByName(back)
