"""Queries over texts, paths, diffs and events of changes, and of reports on them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeprism.functions import diff, text
from changeprism.operators import coupling, extractors, report, review, summary, units
from changeprism.plans.graph import _LAST, issues, pulls
from changeprism.plans.history import _KEYS, _words
from changeprism.plans.registry import Registry, as_of, r6
from changeprism.plans.units import NOW, UNIT, _changes, _hits, _P, _risk, _RISK
from changeprism.session import table
from changeprism.sources import gitlog, sinks
from changeprism.sources.gitlog import commit_files

query = Registry()
QUERIES, SQL = query.queries, query.sql

_STOP_2 = ", ".join(f"'{w}'" for w in text.STOP_WORDS_2)


def _plain(c: str) -> str:
    bare = f"list_transform(string_split_regex(lower(coalesce({c}, '')), '\\s+'), lambda w: regexp_replace(w, '^[.,!?;:\"''()\\[\\]{{}}#]+|[.,!?;:\"''()\\[\\]{{}}#]+$', '', 'g'))"
    return f"list_sort(list_distinct(list_filter({bare}, lambda w: length(w) >= 3 AND w NOT IN ({_STOP_2}))))"


@query(f"WITH x AS (SELECT id, {_plain('title')} AS t, {_plain('body')} AS b FROM github_issues) SELECT id, t AS words, round(coalesce(len(list_intersect(t, b)) / nullif(len(list_distinct(list_concat(t, b))), 0)::DOUBLE, 0), 6) AS similarity FROM x")
def text_plain_keywords(s, d):
    t = table(s, d, "github_issues", "id", "title", "body")
    return t.select("id", text.plain_keywords(F.col("title")).alias("words"), F.round(text.plain_similarity(F.col("title"), F.col("body")), 6).alias("similarity"))


def _near(w: str) -> str:
    return f"(strpos(low, '{w}') > 0 AND spot > 0 AND abs(strpos(low, '{w}') - spot) < 100)"


_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(_near(w) for w in words)} THEN '{k}'" for k, words in review.REFERENCE_WORDS.items()) + " ELSE 'mentions' END"


@query(f"""WITH {_LAST}, x AS (SELECT l.id, substr(coalesce(p.title, '') || ' ' || coalesce(p.body, ''), 1, 500) AS t, '#' || issue_number AS r FROM github_issue_pr_links l JOIN p ON p.repo_id = l.repo_id AND p.number = l.pr_number WHERE issue_number IS NOT NULL), y AS (SELECT *, lower(t) AS low, strpos(t, r) AS spot FROM x) SELECT id, {_KIND} AS kind FROM y""")
def text_reference_types(s, d):
    l = table(s, d, "github_issue_pr_links", "id", "repo_id", "issue_number", "pr_number").where("issue_number IS NOT NULL").withColumnRenamed("id", "link")  # noqa: E741
    p = pulls(s, d, "body").select("repo_id", F.col("number").alias("pr_number"), "title", "body")
    whole = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    return l.join(p, ["repo_id", "pr_number"]).select(F.col("link").alias("id"), review.reference_type(whole, F.col("issue_number")).alias("kind"))


@query("""WITH x AS (SELECT id, body AS t, strpos(body, 'queue') AS spot, length(body) AS n FROM github_issues WHERE body IS NOT NULL), y AS (SELECT *, greatest(spot - 50, 1) AS a, least(spot + 5 + 50, n + 1) AS z FROM x)
SELECT id, CASE WHEN spot = 0 THEN substr(t, 1, 100) ELSE CASE WHEN a > 1 THEN '...' ELSE '' END || substr(t, a, z - a) || CASE WHEN z <= n THEN '...' ELSE '' END END AS snippet FROM y""")
def text_snippets(s, d):
    return table(s, d, "github_issues", "id", "body").where("body IS NOT NULL").select("id", text.snippet(F.col("body"), F.lit("queue")).alias("snippet"))


@query("SELECT doc_id, length(CASE WHEN length(text) > 2000 THEN substr(text, 1, 1000) || '...[truncated]...' || substr(text, length(text) - 499, 500) ELSE text END) AS n FROM documents WHERE text IS NOT NULL")
def text_shortened(s, d):
    return table(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.length(text.shortened(F.col("text"))).cast("bigint").alias("n"))


_SIG = "'( ' || replace(p_name, ' ', '_') || ':str, b: int64' || CASE WHEN p_size % 3 = 0 THEN ', c : bool' WHEN p_size % 3 = 1 THEN ')' ELSE '' END"


@query(f"""WITH x AS (SELECT p_partkey, regexp_replace({_SIG}, '\\s+', '', 'g') AS s, p_size FROM part) SELECT p_partkey, regexp_replace(regexp_replace(replace(replace(s, 'int64', 'int'), 'int32', 'int'), ':str([,)])', ':string\\1', 'g'), ':bool([,)]|$)', ':boolean\\1', 'g') AS signature, CASE WHEN p_size % 3 = 1 THEN 2 ELSE 0 END AS parameters FROM x""")
def text_signatures(s, d):
    """Names of parts as parameters; only closed lists have a count."""
    t = table(s, d, "part", "p_partkey", "p_name", "p_size")
    end = F.when(F.col("p_size") % 3 == 0, ", c : bool").when(F.col("p_size") % 3 == 1, ")").otherwise("")
    sig = F.concat(F.lit("( "), F.regexp_replace("p_name", " ", "_"), F.lit(":str, b: int64"), end)
    return t.select("p_partkey", text.signature(sig).alias("signature"), text.parameter_count(sig).alias("parameters"))


@query("""WITH x AS (SELECT a.p_partkey AS a, b.p_partkey AS b, '(' || a.p_name || ')' AS s, '(' || b.p_name || ')' AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), y AS (SELECT a, b, replace(s, ' ', '') AS s, replace(t, ' ', '') AS t FROM x) SELECT a, b FROM y WHERE s = t OR levenshtein(s, t) <= greatest(length(s), length(t)) // 5""")
def text_alike_signatures(s, d):
    t = table(s, d, "part", "p_partkey", "p_name")
    a, b = t.select(F.col("p_partkey").alias("a"), F.concat(F.lit("("), "p_name", F.lit(")")).alias("s")), t.select(F.col("p_partkey").alias("b"), (F.col("p_partkey") - 1).alias("a"), F.concat(F.lit("("), "p_name", F.lit(")")).alias("t"))
    return a.join(b, "a").where(text.alike_signatures(F.col("s"), F.col("t"))).select("a", "b")


_PATHS = "list_distinct(list_filter(list_transform(string_split_regex({}, '\\s+'), lambda w: regexp_replace(w, '^[.,;:()\\[\\]{{}}\"'']+|[.,;:()\\[\\]{{}}\"'']+$', '', 'g')), lambda w: regexp_matches(w, '\\.(?:go|py|js|ts|java|rb|php|c|cpp|h|rs|sql)$')))"


@query(f"SELECT id, list_sort({_PATHS.format(chr(40) + 'coalesce(body, ' + chr(39) * 2 + '))')}) AS paths FROM github_issues")
def text_file_paths(s, d):
    return table(s, d, "github_issues", "id", "body").select("id", F.array_sort(text.file_paths(F.col("body"))).alias("paths"))


@query(f"""WITH w AS (SELECT id, coalesce(body, '') || ' ' || coalesce(title, '') AS w, coalesce(title, '') AS r FROM github_issues), x AS (SELECT id, w, r, unnest({_PATHS.format('w')}) AS path FROM w)
SELECT id, path, CASE WHEN (length(w) - length(replace(w, path, ''))) / length(path) > 1 THEN 9e-1 WHEN contains(r, path) THEN 8e-1 ELSE 6e-1 END AS confidence FROM x""")
def text_suggested_files(s, d):
    """Bodies as descriptions, titles as root causes."""
    t = table(s, d, "github_issues", "id", "title", "body")
    return t.select("id", F.explode(text.suggested_files(F.col("body"), F.col("title"))).alias("f")).select("id", "f.path", "f.confidence")


@query("SELECT id, split_part(full_name, '/', 1) AS owner, split_part(full_name, '/', 2) AS name FROM github_repositories WHERE full_name IS NOT NULL")
def text_repository_urls(s, d):
    t = table(s, d, "github_repositories", "id", "full_name").where("full_name IS NOT NULL")
    url = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://x.example/"), "full_name", F.lit(".git"))).when(F.col("id") % 3 == 1, F.concat(F.lit("git@x.example:"), "full_name", F.lit(".git"))).otherwise(F.concat(F.lit("https://u@x.example/"), "full_name", F.lit("/")))
    return t.select("id", text.repository_of(url).alias("r")).select("id", "r.owner", "r.name")


def _paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dead_letter_queue", "id", "metadata", "retry_count").select("id", F.get_json_object("metadata", "$.file_path").alias("path"), "retry_count").where("path IS NOT NULL")


_Q = "q AS (SELECT id, try_cast(metadata AS JSON) ->> '$.file_path' AS path, retry_count FROM dead_letter_queue), f AS (SELECT id, path, retry_count, regexp_extract(path, '([^/]*)$', 1) AS base, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)[^/]*$', 1) ELSE '' END AS dir FROM q WHERE path IS NOT NULL), g AS (SELECT *, regexp_extract(base, '(\\.[^.]*)$', 1) AS dot FROM f)"
_LANG = "CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'java' THEN 'java' WHEN 'rb' THEN 'ruby' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'sh' THEN 'shell' WHEN 'md' THEN 'markdown' WHEN 'sql' THEN 'sql' ELSE 'unknown' END"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _any(c: str, f: str, values: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{f}({c}, '{v}')" for v in values) + ")"


@query(f"""WITH {_Q}, e AS (SELECT *, CASE WHEN dot = '' THEN base ELSE dot END AS ext FROM g) SELECT id, {_LANG} AS language, CASE WHEN contains(lower(path), 'test') THEN 'test' WHEN contains(lower(path), 'config') THEN 'config' WHEN regexp_matches(lower(path), '\\.(?:md|txt|doc)$') THEN 'docs' ELSE 'source' END AS kind,
coalesce(CASE WHEN retry_count = 0 THEN 'deleted' WHEN retry_count * 10000 > 51200 THEN 'large' WHEN ext IN {_in(diff.SKIP_SUFFIX)} THEN 'config' WHEN {_any('path', 'contains', diff.SKIP_PATTERN)} THEN 'generated' WHEN ext NOT IN {_in(diff.PARSED_SUFFIX)} THEN 'unknown' END, 'read') AS reason,
NOT {_any('lower(path)', 'ends_with', diff.BINARY_SUFFIX + diff.DOC_SUFFIX + diff.CONFIG_SUFFIX)} AND NOT starts_with(base, '.') AND {_any('lower(path)', 'ends_with', diff.CODE_SUFFIX)} AS code, regexp_matches(path, '(?i)\\.(?:md|txt|rst|adoc)$') OR regexp_matches(path, '(?i)(?:README|LICENSE|CHANGELOG|AUTHORS|CONTRIBUTORS)') AS docs FROM e""")
def diff_file_filters(s, d):
    """Retries stand for sizes of 10 000 bytes each, none for a deleted file."""
    p = F.col("path")
    t = _paths(s, d).where("retry_count IS NOT NULL")
    return t.select("id", text.language(p).alias("language"), text.file_kind(p).alias("kind"), F.coalesce(diff.skip_reason(p, F.col("retry_count") == 0, F.col("retry_count") * 10000), F.lit("read")).alias("reason"), diff.code_file(p).alias("code"), review.docs_only(F.array(p)).alias("docs"))


@query(f"""WITH {_Q}, e AS (SELECT *, left(base, length(base) - length(dot)) AS stem FROM g) SELECT id, CASE WHEN dot = '.py' THEN [dir || 'test_' || base, dir || stem || '_test.py', dir || 'tests/test_' || base] WHEN dot IN ('.js', '.ts', '.jsx', '.tsx') THEN [dir || stem || '.test' || dot, dir || stem || '.spec' || dot, dir || '__tests__/' || base]
WHEN dot = '.go' THEN [dir || stem || '_test.go'] ELSE [] END AS tests FROM e""")
def text_test_names(s, d):
    return _paths(s, d).select("id", text.test_names(F.col("path")).alias("tests"))


@query("""WITH l AS (SELECT id, unnest(string_split(message, chr(10))) AS line FROM github_commits WHERE message IS NOT NULL), b AS (SELECT id, line, trim(regexp_replace(trim(line, ' '), '^[+-]', ''), ' ') AS x FROM l)
SELECT id, sum(CASE WHEN x = '' OR regexp_matches(x, '^(?://|#|/\\*)') THEN 0 ELSE 2 * (length(x) - length(replace(x, '(', ''))) + 2 * (length(x) - length(replace(x, '{', ''))) + length(x) - length(replace(x, '=', '')) + length(x) - length(replace(x, '.', '')) + len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')) END)::BIGINT AS density, sum(length(line) // 4)::BIGINT AS tokens FROM b GROUP BY 1""")
def text_code_density(s, d):
    t = table(s, d, "github_commits", "id", "message").where("message IS NOT NULL").select("id", F.explode(F.split("message", "\n")).alias("line"))
    return t.groupBy("id").agg(F.sum(text.code_density(F.col("line"))).alias("density"), F.sum(text.token_estimate(F.col("line"))).alias("tokens"))


@query("SELECT id, greatest(len(string_split(body, chr(10))) - 1, 0) AS added, 0 AS deleted FROM github_issues WHERE body <> '' AND title <> ''")
def diff_line_deltas(s, d):
    """From a title, which is one line, to a body."""
    t = table(s, d, "github_issues", "id", "title", "body").where("body != '' AND title != ''")
    return t.select("id", diff.line_delta(F.col("title"), F.col("body")).alias("x")).select("id", F.col("x.added").cast("bigint").alias("added"), "x.deleted")


def _made_diff(s: SparkSession, d: str) -> DataFrame:
    """A diff of two files from the counts of each commit, so that SQL knows what is in it."""
    t = table(s, d, "github_commits", "id", "additions", "deletions", "files_changed", "total_changes").where("additions IS NOT NULL AND deletions IS NOT NULL AND files_changed IS NOT NULL AND total_changes IS NOT NULL")
    a, b, n, k = (F.col(c).cast("string") for c in ("additions", "deletions", "files_changed", "total_changes"))
    first = F.concat(F.lit("diff --git a/src/"), k, F.lit(".py b/src/"), k, F.lit(".py\n--- a/x\n+++ b/x\n@@ -"), b, F.lit(",2 +"), a, F.lit(","), n, F.lit(" @@\n x\n+y\n-z\n+w\n@@ -9000 +9000 @@\n-a\n+b"))
    second = F.concat(F.lit("\ndiff --git a/old b/new\nsimilarity index 90%\nrename from old\nrename to new\n@@ -"), n, F.lit(" +"), n, F.lit(" @@\n+q"))
    return t.select("id", "additions", F.concat(first, second).alias("diff"))


_N = "n AS (SELECT * FROM github_commits WHERE additions IS NOT NULL AND deletions IS NOT NULL AND files_changed IS NOT NULL AND total_changes IS NOT NULL)"


@query(f"""WITH {_N} SELECT id, 'src/' || total_changes || '.py' AS path, 'modified' AS change_type, 3 AS added, 2 AS removed, additions AS first, greatest(additions + files_changed - 1, 9000) AS last FROM n WHERE additions <= 9000 UNION ALL SELECT id, 'src/' || total_changes || '.py', 'modified', 3, 2, 9000, greatest(additions + files_changed - 1, 9000) FROM n WHERE additions > 9000
UNION ALL SELECT id, 'new', 'renamed', 1, 0, files_changed, files_changed FROM n""")
def diff_files(s, d):
    f = diff.parse_diff(_made_diff(s, d), "id", "diff")
    return f.select("id", "path", "change_type", "added", "removed", diff.line_range(F.col("hunks")).alias("r")).select("id", "path", "change_type", "added", "removed", "r.first", "r.last")


@query(f"WITH {_N} SELECT id, [additions + 1, additions + 2, 9000] AS lines FROM n")
def diff_changed_lines(s, d):
    """New lines of the first file of each diff."""
    return _made_diff(s, d).select("id", diff.changed_lines(F.split("diff", "\ndiff --git")[0]).alias("lines"))


@query(f"""WITH {_Q}, a AS (SELECT id, path, CASE id % 4 WHEN 0 THEN path WHEN 1 THEN '/' || path WHEN 2 THEN base ELSE 'no/' || base END AS asked FROM f) SELECT id, CASE id % 4 WHEN 0 THEN path WHEN 1 THEN path WHEN 2 THEN path END AS found FROM a""")
def diff_matching_paths(s, d):
    """Each path by itself, with a slash, by its last part and by a wrong one, against itself."""
    t = _paths(s, d)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    asked = F.when(F.col("id") % 4 == 0, F.col("path")).when(F.col("id") % 4 == 1, F.concat(F.lit("/"), "path")).when(F.col("id") % 4 == 2, base).otherwise(F.concat(F.lit("no/"), base))
    return t.select("id", diff.matching_path(asked, F.array("path")).alias("found"))


@query()
def diff_extracted_chunks(s, d):
    """Chunks of the code files of commits; SQL would have to read patches out of every shape of JSON."""
    return diff.extracted_chunks(commit_files(table(s, d, "github_commits", "repo_id", "sha", "raw_data"))).select("repo_id", "sha", "filename", "kind", "number", "batch", F.length("content").alias("chars"), "skipped")


@query(f"""WITH {_N}, c AS (SELECT id AS key, unnest([additions + 1, additions + 2, 9000]) AS line FROM n), k AS (SELECT id AS key, 'low' AS candidate, 1 AS position, 0 AS a, additions + 1 AS z FROM n UNION ALL SELECT id, 'mid', 2, additions + 1, additions + 50 FROM n UNION ALL SELECT id, 'high', 3, 9000, 9001 FROM n),
o AS (SELECT k.*, (SELECT count(*) FROM c WHERE c.key = k.key AND line BETWEEN a AND z) AS overlap FROM k) SELECT key, candidate, round(greatest(5e-1, overlap / 3e0), 6) AS confidence FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY overlap DESC, position) = 1""")
def diff_by_overlap(s, d):
    lines = _made_diff(s, d).select(F.col("id").alias("key"), "additions", F.explode(diff.changed_lines(F.split("diff", "\ndiff --git")[0])).alias("line"))
    t = _made_diff(s, d).select(F.col("id").alias("key"), F.col("additions").alias("x"))
    c = lambda name, p, a, z: t.select("key", F.lit(name).alias("candidate"), F.lit(p).alias("position"), a.cast("int").alias("start_line"), z.cast("int").alias("end_line"))
    x = F.col("x")
    k = c("low", 1, F.lit(0), x + 1).unionByName(c("mid", 2, x + 1, x + 50)).unionByName(c("high", 3, F.lit(9000), F.lit(9001)))
    return units.by_overlap(lines.select("key", "line"), k).select("key", "candidate", *r6("confidence"))


_EV = """e AS (SELECT l_orderkey AS f, l_suppkey AS b, '( x' || CASE WHEN l_tax > 4e-2 THEN ' )' ELSE ')' END AS sig, CASE l_returnflag WHEN 'A' THEN 'CREATE_BLOCK' WHEN 'N' THEN 'MODIFY_BLOCK' ELSE 'DELETE_BLOCK' END AS beh, l_linenumber AS seq, l_partkey::VARCHAR AS v FROM lineitem)"""


@query(f"""WITH {_EV} SELECT f::VARCHAR AS target_file, b::VARCHAR AS block_name, arg_max(beh, (CASE beh WHEN 'MODIFY_BLOCK' THEN 3 WHEN 'CREATE_BLOCK' THEN 2 ELSE 1 END, -seq)) AS behavior, string_agg(v, chr(10) || chr(10) || '// [Chunk boundary]' || chr(10) || chr(10) ORDER BY seq, v) AS new_version FROM e GROUP BY f, b""")
def review_merged_events(s, d):
    """Order lines as events of a file (order) and a unit (supplier)."""
    t = table(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_tax", "l_returnflag")
    beh = F.when(F.col("l_returnflag") == "A", "CREATE_BLOCK").when(F.col("l_returnflag") == "N", "MODIFY_BLOCK").otherwise("DELETE_BLOCK")
    e = t.select(F.col("l_orderkey").cast("string").alias("target_file"), F.col("l_suppkey").cast("string").alias("block_name"), F.concat(F.lit("( x"), F.when(F.col("l_tax") > 0.04, " )").otherwise(")")).alias("signature"), F.lit(None).cast("string").alias("dependency_path"), beh.alias("behavior"), F.lit("").alias("old_version"), F.col("l_partkey").cast("string").alias("new_version"), F.col("l_linenumber").alias("seq"))
    return review.merge_events(e).select("target_file", "block_name", "behavior", "new_version")


@query("""WITH e AS (SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN 'MOVE' WHEN 1 THEN 'ADD_IMPORT' ELSE 'MODIFY_BLOCK' END AS beh, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS f, CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_name END AS b, CASE p_size % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'macro' WHEN 2 THEN 'Const' ELSE '' END AS t FROM part), r AS (SELECT *, CASE WHEN beh = 'MOVE' THEN 'behavior' WHEN f = '' THEN 'file' WHEN beh <> 'ADD_IMPORT' AND b = ' ' THEN 'name' WHEN t = 'Const' THEN 'kind' END AS reason FROM e)
SELECT id, coalesce(reason, 'ok') AS reason, CASE WHEN reason IS NULL AND t = 'macro' THEN 'function' ELSE t END AS block_type FROM r""")
def review_checked_events(s, d):
    t, n = table(s, d, "part", "p_partkey", "p_name", "p_brand", "p_size"), F.col("p_size")
    beh = F.when(n % 7 == 0, "MOVE").when(n % 7 == 1, "ADD_IMPORT").otherwise("MODIFY_BLOCK")
    kind = F.when(n % 4 == 0, "method").when(n % 4 == 1, "macro").when(n % 4 == 2, "Const").otherwise("")
    e = t.select(F.col("p_partkey").alias("id"), beh.alias("behavior"), F.when(n % 5 == 0, "").otherwise(F.col("p_brand")).alias("target_file"), F.when(n % 11 == 0, " ").otherwise(F.col("p_name")).alias("block_name"), kind.alias("block_type"))
    return review.checked_events(e).select("id", F.coalesce("reason", F.lit("ok")).alias("reason"), "block_type")


@query("SELECT l_orderkey, count(*) AS files, sum(l_quantity)::BIGINT AS changes, list(l_partkey ORDER BY l_quantity DESC, l_partkey) AS names FROM lineitem GROUP BY 1")
def review_pull_files(s, d):
    """Orders as pull requests, parts as files, quantities as changes."""
    t = table(s, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity").toDF("pull", "name", "changes")
    return review.file_summary(t, ["pull"]).select(F.col("pull").alias("l_orderkey"), "files", F.col("changes").cast("bigint").alias("changes"), "names")


@query(f"""WITH x AS (SELECT id, coalesce(title, '') || ' ' || coalesce(body, '') AS w FROM github_issues), y AS (SELECT id, {_words("w")} AS a FROM x), q AS (SELECT {_words("'the queue hangs after the legacy cache was split'")} AS b), z AS (SELECT id, {_KEYS.replace("(k, ", "(a, ").replace("_transform(k", "_transform(a")} AS a, {_KEYS.replace("(k, ", "(b, ").replace("_transform(k", "_transform(b")} AS b FROM y, q)
SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS score FROM z WHERE len(list_intersect(a, b)) > 0 AND len(a) > 0 ORDER BY score DESC, id LIMIT 10""")
def incident_similar(s, d):
    return report.similar(table(s, d, "github_issues", "id", "title", "body"), "id", ["title", "body"], "the queue hangs after the legacy cache was split")


@query("SELECT id FROM github_issues WHERE contains(coalesce(title, '') || ' ' || coalesce(body, ''), '.env') AND created_at BETWEEN TIMESTAMP '2017-01-01' AND TIMESTAMP '2021-01-01'")
def incident_of_file(s, d):
    t = report.naming_file(table(s, d, "github_issues", "id", "title", "body", "created_at"), ["title", "body"], "deploy/x/.env")
    return report.between(t, "created_at", as_of("2017-01-01 00:00:00"), as_of("2021-01-01 00:00:00")).select("id")


@query("SELECT labels AS severity, id FROM github_issues WHERE labels IS NOT NULL QUALIFY row_number() OVER (PARTITION BY labels ORDER BY created_at DESC NULLS LAST, id) <= 3")
def incident_by_severity(s, d):
    t = table(s, d, "github_issues", "id", "labels", "created_at").where("labels IS NOT NULL")
    return units.recent_changes(t.select(F.col("labels").alias("severity"), "id", F.col("id").alias("sha"), F.col("created_at").alias("at")), ["severity"], 3).select("severity", "id")


@query("""WITH l AS (SELECT issue_number AS incident, detection_method AS path, final_confidence AS c FROM github_issue_pr_links WHERE detection_method IS NOT NULL) SELECT incident, path, max(c) AS confidence FROM l WHERE c BETWEEN 0 AND 1 AND incident IN (SELECT number FROM github_issues) GROUP BY 1, 2""")
def incident_file_links(s, d):
    """Methods stand for files."""
    l = table(s, d, "github_issue_pr_links", "issue_number", "detection_method", "final_confidence").toDF("incident", "path", "confidence")  # noqa: E741
    return report.checked_file_links(l, table(s, d, "github_issues", "number").withColumnRenamed("number", "incident"))


@query("""WITH a AS (SELECT p_name AS path FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part), c AS (SELECT DISTINCT p_brand AS path FROM part), f AS (SELECT p_name AS path, min(p_brand) AS found FROM part GROUP BY 1)
SELECT path, CASE WHEN path IN (SELECT path FROM c) THEN path ELSE coalesce(f.found, path) END AS found, CASE WHEN path IN (SELECT path FROM c) THEN 1e0 WHEN f.found IS NOT NULL THEN 95e-2 ELSE 3e-1 END AS confidence FROM a LEFT JOIN f USING (path)""")
def graph_resolved_paths(s, d):
    t = table(s, d, "part", "p_name", "p_brand", "p_type")
    a = t.select(F.col("p_name").alias("path")).unionByName(t.select(F.col("p_brand").alias("path"))).unionByName(t.select(F.col("p_type").alias("path")))
    return report.resolved_paths(a, t.select(F.col("p_brand").alias("path")), t.select(F.col("p_name").alias("path"), F.col("p_brand").alias("canonical")))


@query("SELECT r.id AS repo_id, count(c.id) > 0 AS initialised, count(c.id) AS commits FROM github_repositories r LEFT JOIN github_commits c ON c.repo_id = r.id GROUP BY 1")
def sync_repository_states(s, d):
    r = table(s, d, "github_repositories", "id").withColumnRenamed("id", "repo_id")
    return report.repository_state(r, table(s, d, "github_commits", "repo_id", "author_date").toDF("repo_id", "at")).select("repo_id", "initialised", "commits")


@query("SELECT c.id, m.message FROM github_pull_requests c JOIN (SELECT repo_id, sha, min(message) AS message FROM github_commits WHERE message IS NOT NULL GROUP BY 1, 2) m ON m.repo_id = c.repo_id AND m.sha = c.merge_commit_sha")
def unit_messages_of_merges(s, d):
    m = table(s, d, "github_commits", "repo_id", "sha", "message").where("message IS NOT NULL").groupBy("repo_id", "sha").agg(F.min("message").alias("message"))
    p = table(s, d, "github_pull_requests", "id", "repo_id", "merge_commit_sha").withColumnRenamed("merge_commit_sha", "sha")
    return p.join(m, ["repo_id", "sha"]).select("id", "message")


@query("WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {k}, {x}::DOUBLE, {r}::DOUBLE)" for c, k, x, r in report.THRESHOLDS) + ") t(config, coupling, co_change, test_ratio)), p AS (SELECT id, CASE WHEN lang = 'en' THEN 'go_web' WHEN lang = 'de' THEN 'cli_tool' WHEN lang = 'fr' THEN 'odd' END AS c FROM (SELECT doc_id AS id, lang FROM documents)) SELECT id, coupling, test_ratio FROM p JOIN t ON t.config = CASE WHEN c IN ('go_web', 'cli_tool') THEN c ELSE 'default' END")
def risk_thresholds(s, d):
    """Languages of documents stand for kinds of projects, one of them unknown."""
    lang = F.col("lang")
    t = table(s, d, "documents", "doc_id", "lang").select(F.col("doc_id").alias("id"), F.when(lang == "en", "go_web").when(lang == "de", "cli_tool").when(lang == "fr", "odd").alias("config"))
    return report.with_thresholds(t).select("id", "coupling", "test_ratio")


_REPORT = f"""WITH {_P}, l AS (SELECT repo_id, block, max(t_at) AS last_at FROM ch GROUP BY 1, 2), w2 AS (SELECT u.repo_id, u.block, name, file, kind, ((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(last_at)) // 86400000000)::BIGINT AS staleness_days FROM u LEFT JOIN l USING (repo_id, block)),
z AS (SELECT repo_id, a AS block, b AS other, rate FROM pairs UNION ALL SELECT repo_id, b, a, rate FROM pairs), c AS (SELECT repo_id, block, sum(rate) AS rates FROM (SELECT * FROM z WHERE rate >= 2e-2 QUALIFY row_number() OVER (PARTITION BY repo_id, block ORDER BY rate DESC, other) <= 20) GROUP BY 1, 2),
n AS (SELECT repo_id, block, least(count(*), 10) AS n, max(t_at) AS t_at, arg_max(issue, (t_at, -issue)) AS newest FROM h GROUP BY 1, 2), k AS (SELECT w2.*, coalesce(n, 0) AS incident_count, newest, coalesce(staleness_days, 0) AS sd FROM w2 LEFT JOIN n USING (repo_id, block)),
x AS (SELECT k.repo_id, k.block, k.kind, k.staleness_days, incident_count, newest, round(incident_count * 10e0 + coalesce(rates, 0) * 2e0 + least(sd / 30e0, 3e0) + CASE WHEN kind = 'class' THEN 2e0 ELSE 0 END + CASE WHEN sd < 30 THEN (30 - sd) / 30e0 * 5e0 ELSE 0 END, 6) AS risk_score FROM k LEFT JOIN c USING (repo_id, block) WHERE incident_count >= 1)"""


def _report(s: SparkSession, d: str, **more) -> DataFrame:
    pairs = coupling.cochange_pairs(_changes(s, d), as_of(NOW), 365, 1, 0.01, by=("repo_id",))
    return report.risk_report(_risk(s, d).drop("incidents"), pairs, _hits(s, d), min_incidents=1, min_rate=0.02, prioritize_recent=True, include_score=True, **more)


@query(_REPORT + " SELECT repo_id, block, incident_count, newest, risk_score FROM x ORDER BY risk_score DESC, repo_id, block LIMIT 10")
def risk_report(s, d):
    return _report(s, d).select("repo_id", "block", F.col("incident_count").cast("bigint").alias("incident_count"), F.col("incidents")[0]["issue"].alias("newest"), "risk_score")


@query(_REPORT + ", a AS (SELECT count(*) AS total_blocks FROM u WHERE repo_id = 'r1') SELECT total_blocks, count(*) AS matching_blocks, count(DISTINCT kind) AS block_kinds, sum(incident_count)::BIGINT AS total_incidents, max(staleness_days) AS max_staleness FROM x, a WHERE repo_id = 'r1' GROUP BY 1")
def risk_report_summary(s, d):
    """The summary of one repository."""
    return report.report_summary(_risk(s, d).where("repo_id = 'r1'"), _report(s, d, repo_id="r1", max_blocks=0))


@query(f"""WITH {_LAST}, x AS (SELECT id, list_distinct(list_transform(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '(?:fix|fixes|fixed|close|closes|closed|resolve|resolves|resolved)\\s+#([0-9]{{1,9}})', 1), lambda v: v::INT)) AS r, substr(coalesce(title, '') || ' ' || coalesce(body, ''), 1, 500) AS t FROM p),
y AS (SELECT id, unnest(r) AS number, t, lower(t) AS low FROM x), z AS (SELECT *, strpos(t, '#' || number) AS spot FROM y) SELECT id, number, {_KIND} AS kind FROM z""")
def text_extracted_references(s, d):
    return extractors.extract_references(pulls(s, d, "body").select("id", "title", "body")).select("id", "number", "kind")


@query(f"WITH {_LAST} SELECT id, CASE WHEN contains(lower(coalesce(labels, '') || ' ' || coalesce(body, '')), 'duplicate') THEN 'duplicate' WHEN contains(lower(coalesce(labels, '') || ' ' || coalesce(body, '')), 'wontfix') OR contains(lower(coalesce(labels, '') || ' ' || coalesce(body, '')), 'won''t fix') THEN 'wontfix' WHEN contains(lower(coalesce(labels, '') || ' ' || coalesce(body, '')), 'not a bug') OR contains(lower(coalesce(labels, '') || ' ' || coalesce(body, '')), 'works as intended') THEN 'not_a_bug' WHEN contains(lower(coalesce(labels, '') || ' ' || coalesce(body, '')), 'needs info') OR contains(lower(coalesce(labels, '') || ' ' || coalesce(body, '')), 'no response') THEN 'user_action_required' ELSE 'fixed_with_code' END AS classification FROM i WHERE closed_at IS NOT NULL")
def link_closure_classes(s, d):
    i = issues(s, d, "body").where("closed_at IS NOT NULL").select("id", "labels", F.col("body").alias("comment"))
    return extractors.classify_closures(i).select("id", "classification")


@query(f"WITH {_RISK} SELECT repo_id, block, incidents, last_modifier FROM w")
def graph_node_properties(s, d):
    """Units as nodes with the properties of ownership and incidents."""
    r = _risk(s, d)
    return sinks.with_properties(r.select(*UNIT, "name"), r.select(*UNIT, "incidents", "last_modifier"), list(UNIT)).drop("name")


@query("SELECT repo_id, list_sort(list(DISTINCT state)) AS states, count(*) AS issues, round(count(*) FILTER (closed_at IS NOT NULL) * 100e0 / count(*), 6) AS closed_percent FROM github_issues WHERE state IS NOT NULL GROUP BY 1")
def incident_distribution(s, d):
    t = table(s, d, "github_issues", "repo_id", "state", "closed_at").where("state IS NOT NULL")
    return t.groupBy("repo_id").agg(F.array_sort(F.collect_set("state")).alias("states"), F.count("*").alias("issues"), F.round(F.count("closed_at") * 100.0 / F.count("*"), 6).alias("closed_percent"))


@query(f"""WITH {_P}, m AS (SELECT DISTINCT repo_id, sha FROM ch WHERE block < 4), tt AS (SELECT count(*) AS t FROM m), n AS (SELECT block AS other, count(DISTINCT ch.sha) AS n, list_sort(list(DISTINCT ch.sha))[1:3] AS sample FROM ch SEMI JOIN m ON m.repo_id = ch.repo_id AND m.sha = ch.sha WHERE block >= 4 GROUP BY 1) SELECT other, n, sample FROM n, tt WHERE n >= 3 OR n / t::DOUBLE >= 3e-1 ORDER BY n DESC, other LIMIT 10""")
def coupling_partners_with_samples(s, d):
    """Partners of the first units with three commits that show it."""
    c = _changes(s, d).withColumn("sha", F.struct("repo_id", "sha"))
    p = summary.partners(c, [0, 1, 2, 3], samples=3)
    return p.select("other", "n", F.transform("sample", lambda x: x["sha"]).alias("sample"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS sha, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1 AND p_partkey // 2 IN (SELECT p_partkey FROM part)), r AS (SELECT p_partkey AS sha, 0 AS depth FROM part WHERE p_partkey NOT IN (SELECT sha FROM e) UNION ALL SELECT e.sha, r.depth + 1 FROM r JOIN e ON e.parent = r.sha)
SELECT r.sha, depth, row_number() OVER (ORDER BY depth, p_size, r.sha) - 1 AS position FROM r JOIN part ON p_partkey = r.sha""")
def graph_topological_order(s, d):
    """Half a part's number is its parent, its size the date."""
    t = table(s, d, "part", "p_partkey", "p_size")
    p = t.select(F.col("p_partkey").alias("sha"), F.when(F.col("p_partkey") > 1, F.array(F.expr("p_partkey div 2"))).alias("parents"), F.col("p_size").alias("date"))
    return gitlog.topological_order(p).select("sha", "depth", "position")


@query("""WITH p AS (SELECT p_brand, p_partkey::VARCHAR AS sha, (p_partkey // 2)::VARCHAR AS parent FROM part), g AS (SELECT p_brand, substr(sha256(sha), 1, 2) AS part, sha256(string_agg(sha || ':' || parent, chr(10) ORDER BY sha || ':' || parent)) AS h, count(*) AS n FROM p GROUP BY 1, 2)
SELECT p_brand, sum(n)::BIGINT AS commits, sha256(string_agg(h, chr(10) ORDER BY part)) AS hash FROM g GROUP BY 1""")
def graph_parent_hash(s, d):
    t = table(s, d, "part", "p_partkey", "p_brand")
    p = t.select("p_brand", F.col("p_partkey").cast("string").alias("sha"), F.array(F.expr("p_partkey div 2").cast("string")).alias("parents"))
    return gitlog.parent_graph_hash(p, ["p_brand"])


@query("""SELECT id, 'cross-referenced' AS event, 'pr' AS source_type, pr_number AS source_number, '' AS source_sha FROM github_issue_pr_links WHERE pr_number IS NOT NULL AND issue_number IS NOT NULL UNION ALL SELECT id, 'closed', 'commit', -1, 'c' || id FROM github_issue_pr_links WHERE pr_number IS NOT NULL AND issue_number IS NOT NULL""")
def graph_timeline_events(s, d):
    """A timeline made of each link."""
    t = table(s, d, "github_issue_pr_links", "id", "issue_number", "pr_number").where("pr_number IS NOT NULL AND issue_number IS NOT NULL")
    doc = F.format_string('[{"event":"cross-referenced","source":{"type":"issue","issue":{"number":%d,"pull_request":{"url":"u"}}}},{"event":"closed","commit_id":"c%d"}]', "pr_number", "id")
    e = gitlog.timeline_events(t.select(F.col("id").alias("repo_id"), "issue_number", doc.alias("events")))
    return e.select(F.col("repo_id").alias("id"), "event", "source_type", F.coalesce("source_number", F.lit(-1)).alias("source_number"), F.coalesce("source_sha", F.lit("")).alias("source_sha"))


@query(f"WITH {_Q} SELECT id FROM f WHERE regexp_matches(path, '{gitlog.SOURCE_NAME}') AND NOT regexp_matches(path, '{gitlog.SKIP_FOLDERS}') AND NOT regexp_matches(path, '{gitlog.GENERATED}')")
def sync_source_files(s, d):
    return gitlog.source_files(_paths(s, d)).select("id")


@query("""WITH RECURSIVE l AS (SELECT id, k - 1 AS i, x, CASE WHEN b = '' OR regexp_matches(b, '^(?://|#|/\\*)') THEN 0 ELSE 2 * (length(b) - length(replace(b, '(', ''))) + 2 * (length(b) - length(replace(b, '{', ''))) + length(b) - length(replace(b, '=', '')) + length(b) - length(replace(b, '.', '')) + len(list_filter(string_split_regex(b, '\\s+'), lambda w: w <> '')) END AS d
FROM (SELECT id, k, x, trim(regexp_replace(trim(x, ' '), '^[+-]', ''), ' ') AS b FROM (SELECT id, unnest(string_split(message, chr(10))) AS x, generate_subscripts(string_split(message, chr(10)), 1) AS k FROM github_commits WHERE message IS NOT NULL))),
o AS (SELECT *, sum(length(x) // 4) OVER (PARTITION BY id ORDER BY d DESC, i ROWS UNBOUNDED PRECEDING) AS used FROM l) SELECT id, count(*) FILTER (used <= 12) AS lines FROM o GROUP BY 1""")
def text_dense_lines(s, d):
    """How many of the densest lines of a message fit into twelve tokens."""
    t = table(s, d, "github_commits", "id", "message").where("message IS NOT NULL")
    return t.select("id", F.size(text.dense_lines(F.split("message", "\n"), F.lit(12))).cast("bigint").alias("lines"))


@query(f"WITH {_LAST} SELECT repo_id, issue_number AS issue, pr_number AS pr FROM github_issue_pr_links WHERE detection_method = 'github_timeline_verified' UNION ALL SELECT repo_id, issue_number, pr_number FROM github_issue_pr_links WHERE detection_method = 'explicit'")
def link_reference_union(s, d):
    """References of timelines and of texts one after the other; what both know stays twice."""
    t = table(s, d, "github_issue_pr_links", "repo_id", "issue_number", "pr_number", "detection_method").toDF("repo_id", "issue", "pr", "method")
    return t.where("method = 'github_timeline_verified'").drop("method").unionByName(t.where("method = 'explicit'").drop("method"))
