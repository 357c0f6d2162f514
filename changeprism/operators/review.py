"""Change filters, event merging and references found in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeprism.functions import text

#: Paths that are documentation (fixed values).
DOC_SUFFIX = r"(?i)\.(?:md|txt|rst|adoc)$"
DOC_NAME = r"(?i)(?:README|LICENSE|CHANGELOG|AUTHORS|CONTRIBUTORS)"
#: Behaviors by strength (fixed values).
PRIORITY = {"RENAME_BLOCK": 4, "MODIFY_BLOCK": 3, "CREATE_BLOCK": 2, "DELETE_BLOCK": 1}


def docs_only(paths: Column) -> Column:
    return (F.size(paths) > 0) & F.forall(paths, lambda p: p.rlike(DOC_SUFFIX) | p.rlike(DOC_NAME))


def tier_zero(changed_lines: Column, paths: Column) -> Column:
    """struct<kind, confidence> of a change by the first rule that holds; changed_lines are its added and removed lines."""
    body = F.transform(changed_lines, lambda x: F.trim(x))
    blank = F.forall(body, lambda x: x == "")
    comment = F.forall(body, lambda x: (x == "") | x.rlike(r"^(?://|#|\*|/\*|--)"))
    few = (F.size(changed_lines) < 10) & (F.size(paths) <= 3)
    rule = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("confidence"))
    return F.when(blank, rule("whitespace", 0.95)).when(comment, rule("comment", 0.90)).when(docs_only(paths), rule("documentation", 0.85)).when(few, rule("small_change", 0.70)).otherwise(rule("complex", 0.80))


#: What stands between the snippets of two chunks (fixed value).
BOUNDARY = "\n\n// [Chunk boundary]\n\n"


def merge_events(events: DataFrame) -> DataFrame:
    """(target_file, block_name, signature, dependency_path, behavior, old_version, new_version) of chunk events of one unit.

    Events are of one unit if file, name and levelled signature agree, imports if their path agrees too. The strongest
    behavior stands (rename, modify, create, delete, others; the first on a tie) with its signature, and the snippets that
    are not empty follow one another in seq order. ``events`` has seq, behavior, old_version, new_version besides.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), F.col("behavior")), F.lit(0))
    e = events.withColumn("rank", rank).withColumn("level", text.signature(F.coalesce("signature", F.lit(""))))
    e = e.withColumn("dependency_path", F.when(F.col("behavior").isin("ADD_IMPORT", "REMOVE_IMPORT"), F.col("dependency_path")))
    joined = lambda c: F.concat_ws(BOUNDARY, F.transform(F.filter(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c] != ""), lambda x: x[c]))
    top = F.max_by(F.struct("behavior", "signature"), F.struct("rank", (-F.col("seq")).alias("s"))).alias("t")
    g = e.groupBy("target_file", "block_name", "level", "dependency_path").agg(top, joined("old_version").alias("old_version"), joined("new_version").alias("new_version"))
    return g.select("target_file", "block_name", "t.signature", "dependency_path", "t.behavior", "old_version", "new_version")


#: Behaviors and kinds of units that are kept, kinds that are no units (fixed values).
BEHAVIORS = ("CREATE_BLOCK", "MODIFY_BLOCK", "DELETE_BLOCK", "RENAME_BLOCK", "ADD_IMPORT", "REMOVE_IMPORT")
UNIT_KINDS, NO_UNITS = ("function", "method", "class", "component"), ("variable", "constant", "var", "const", "text", "documentation", "doc", "markdown")


def checked_events(events: DataFrame) -> DataFrame:
    """``events`` with reason: null for those that stand, with unknown kinds of units read as functions; else why one is refused."""
    off = lambda c: F.coalesce(c, F.lit(True))
    imports = F.col("behavior").isin("ADD_IMPORT", "REMOVE_IMPORT")
    reason = (
        F.when(off(~F.col("behavior").isin(*BEHAVIORS)), "behavior").when(off(F.col("target_file") == ""), "file")
        .when(~imports & off(F.trim("block_name") == ""), "name").when(F.lower("block_type").isin(*NO_UNITS), "kind")
    )
    known = F.col("block_type").isNull() | (F.col("block_type") == "") | F.col("block_type").isin(*UNIT_KINDS)
    return events.withColumn("reason", reason).withColumn("block_type", F.when(known | F.col("reason").isNotNull(), F.col("block_type")).otherwise("function"))


#: Steps of 0.05 after which every confidence has reached 0.95.
_BOOSTS = 20


def merge_references(refs: DataFrame) -> DataFrame:
    """(repo_id, issue, sha, pr, confidence, method, action) of references (… , method, confidence, action, seq) found several times.

    In seq order the greatest confidence stands; from the first reference by another method on each adds 0.05 (0.95 at most)
    and the method is bidirectional; one fix makes the action fixes. After ``_BOOSTS`` such references the confidence is 0.95
    whatever follows, so no more are kept. Null commits and pull requests are keys like others.
    """
    key = ["repo_id", "issue", "sha", "pr"]
    w = Window.partitionBy(*key).orderBy("seq")
    first = refs.withColumn("m", F.first("method").over(w)).withColumn("after", F.max((~F.col("method").eqNullSafe(F.col("m"))).cast("int")).over(w))
    at = F.when(F.col("after") == 1, F.row_number().over(Window.partitionBy(*key, "after").orderBy("seq")))
    g = first.withColumn("at", at).groupBy(*key).agg(
        F.max(F.when(F.col("after") == 0, F.col("confidence"))).alias("c"), F.first("m").alias("m"), F.collect_list(F.when(F.col("at") <= _BOOSTS, F.struct("seq", "confidence"))).alias("later"),
        F.max(F.col("action") == "fixes").alias("fixes"), F.min_by("action", "seq").alias("action"),
    )
    conf = F.aggregate(F.array_sort("later"), F.col("c").cast("double"), lambda a, x: F.least(F.greatest(a, x["confidence"]) + 0.05, F.lit(0.95)))
    return g.select(*key, conf.alias("confidence"), F.when(F.size("later") > 0, "bidirectional").otherwise(F.col("m")).alias("method"), F.when(F.col("fixes"), "fixes").otherwise(F.col("action")).alias("action"))


#: Words that tell how a text speaks of a number, in the order in which they are tried (fixed values).
REFERENCE_WORDS = {
    "fixes": ("fixes", "fix", "fixed", "close", "closes", "closed", "resolve", "resolves", "resolved"), "addresses": ("addresses", "address"),
    "for": ("for issue", "for #"), "mentions": ("mentioned", "mentions", "see", "ref", "related"),
}


def reference_type(text: Column, number: Column) -> Column:
    """How a text speaks of #number: fixes, addresses, for or mentions, by words less than 100 characters away in its first
    500 characters (first places of both); mentions where no word is near."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 500)
    low, at = F.lower(head), F.instr(head, F.concat(F.lit("#"), number.cast("string")))
    near = lambda w: (F.instr(low, F.lit(w)) > 0) & (at > 0) & (F.abs(F.instr(low, F.lit(w)) - at) < 100)
    out = F.lit("mentions")
    for kind, words in reversed(REFERENCE_WORDS.items()):
        for w in reversed(words):
            out = F.when(near(w), kind).otherwise(out)
    return out


def _same(word: str):
    return lambda x: x == F.lit(word)


def search(docs: DataFrame, key: str, fields: list[tuple[str, float]], query: str, k: int = 10) -> DataFrame:
    """(key, score, level): documents that hold every word of ``query``, by weighted word counts; no stemming. The level is high
    above half and medium above a fifth of the greatest score."""
    words = sorted({w for w in query.lower().split() if w})
    score = F.lit(0.0)
    every = F.lit(True)
    for w in words:
        hits = [F.size(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^a-z0-9]+"), _same(w))) for c, _ in fields]
        every = every & (sum(hits) > 0)
        score = score + sum(h * x for h, (_, x) in zip(hits, fields, strict=True))
    best = docs.where(every).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)
    share = F.col("score") / F.max("score").over(Window.partitionBy())  # k rows
    return best.withColumn("level", F.when(share > 0.5, "high").when(share > 0.2, "medium").otherwise("low")).orderBy(F.desc("score"), key)


def unprocessed(rows: DataFrame, at: str, limit: int) -> DataFrame:
    """The oldest rows that no run has processed."""
    return rows.where("processed_at IS NULL").orderBy(at, "id").limit(limit)


def file_summary(files: DataFrame, on: list[str]) -> DataFrame:
    """(on, files, changes, names): of (on, name, changes) the names with most changes first, ties by name."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("changes")).alias("c"), "name")))
    return files.groupBy(*on).agg(F.count("*").alias("files"), F.sum("changes").alias("changes"), F.transform(order, lambda x: x["name"]).alias("names"))


def with_children(parents: DataFrame, children: DataFrame, on: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """``parents`` with an array of their children in order."""
    c = children.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, *keep])))), lambda x: F.struct(*[x[k].alias(k) for k in keep])).alias("children"))
    return parents.join(c, on, "left")
