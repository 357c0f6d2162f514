"""Link quality of repositories: five components, score, grade, status, advice, and the graph form of the score.

Every operator works for all repositories at once: it takes rows with ``repo_id`` and gives one row for each repository.
Tables: ``issues`` (repo_id, number, state, closed_at), one row for each issue; ``links`` (repo_id, issue_number,
confidence, evidence array<string>, delta_seconds, title_score, body_score, comment_score, any of them null);
``excluded`` (repo_id, number, classification). Without links every component but coverage is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeprism.operators import linking

#: Classes of issues that need no link, kinds of evidence, weights of the components, thresholds of a status (fixed values).
NO_LINK_CLASSES = ("not_a_bug", "duplicate", "wontfix", "user_action_required")
EVIDENCE = {
    "explicit": ("explicit",), "github_timeline_verified": ("github_timeline_verified",), "bidirectional": ("bidirectional",),
    "semantic": ("semantic_title", "semantic_body", "semantic_comment"), "temporal": ("temporal",), "file_context": ("file_context",),
}
WEIGHTS = {"coverage": 0.40, "confidence": 0.35, "diversity": 0.15, "precision": 0.05, "strength": 0.05}
STATUS = {"coverage": (90, 80, 70), "confidence": (85, 75, 60), "diversity": (80, 70, 60), "precision": (80, 60, 40), "strength": (80, 70, 60)}
#: Evidence tags and weights of the graph form (fixed values).
GRAPH_PARTS = {
    "explicit": (0.40, ("explicit",)), "temporal": (0.25, ("temporal_match_5min", "temporal_match_1hr", "temporal_match_24hr")),
    "comment": (0.20, ("owner_comment", "collaborator_comment", "bot_comment")), "semantic": (0.10, ()), "bidirectional": (0.05, ("bidirectional_mention",)),
}


def has_any(sources: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(sources, F.array(*[F.lit(n) for n in names])), F.lit(False))


def link_coverage(issues: DataFrame, links: DataFrame, excluded: DataFrame, least: float = 0.5) -> DataFrame:
    """(repo_id, total_closed, eligible, linked, unlinked): closed issues, those that need a link, issues with a link of
    ``least`` confidence (whatever their state), and the difference of the two."""
    closed = issues.where("state = 'closed'").select("repo_id", "number", "closed_at")
    none = excluded.where(F.col("classification").isin(*NO_LINK_CLASSES)).select("repo_id", "number").distinct().withColumn("none", F.lit(True))
    n = closed.join(none, ["repo_id", "number"], "left").groupBy("repo_id").agg(
        F.count("*").alias("total_closed"), F.count_if(F.col("closed_at").isNotNull() & F.col("none").isNull()).alias("eligible")
    )
    linked = links.where(F.col("confidence") >= least).groupBy("repo_id").agg(F.countDistinct("issue_number").alias("linked"))
    out = n.join(linked, "repo_id", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    return out.withColumn("unlinked", F.col("eligible") - F.col("linked"))


def evidence_diversity(links: DataFrame) -> DataFrame:
    """(repo_id, avg_kinds, kinds_6 … kinds_1, one count for each kind, links); the semantic tags are one kind."""
    uses = {k: has_any(F.col("evidence"), v) for k, v in EVIDENCE.items()}
    k = sum((u.cast("int") for u in uses.values()), F.lit(0))
    rows = links.select("repo_id", k.alias("kinds"), *(u.alias(n) for n, u in uses.items()))
    return rows.groupBy("repo_id").agg(
        F.avg("kinds").alias("avg_kinds"), *(F.count_if(F.col("kinds") == i).alias(f"kinds_{i}") for i in range(6, 0, -1)),
        *(F.count_if(n).alias(n) for n in EVIDENCE), F.count("*").alias("links"),
    )


def temporal_precision(links: DataFrame) -> DataFrame:
    """(repo_id, timed, tight, minutes5, hour, day, later) of the distances in seconds, whatever their sign."""
    d = F.abs("delta_seconds")
    return links.where("delta_seconds IS NOT NULL").groupBy("repo_id").agg(
        F.count("*").alias("timed"), F.count_if(d < 3600).alias("tight"), F.count_if(d < 300).alias("minutes5"), F.count_if((d >= 300) & (d < 3600)).alias("hour"),
        F.count_if((d >= 3600) & (d < 86400)).alias("day"), F.count_if(d >= 86400).alias("later"),
    )


def semantic_strength(links: DataFrame) -> DataFrame:
    """(repo_id, scored, avg_max, high, medium, low, avg_title, avg_body, avg_comment) of links with a semantic analysis."""
    s = {n: F.coalesce(F.col(f"{n}_score"), F.lit(0.0)) for n in ("title", "body", "comment")}
    rows = links.where("analysed").select("repo_id", F.greatest(*s.values()).alias("best"), *(v.alias(n) for n, v in s.items()))
    return rows.groupBy("repo_id").agg(
        F.count("*").alias("scored"), F.avg("best").alias("avg_max"), F.count_if(F.col("best") >= 0.7).alias("high"),
        F.count_if((F.col("best") >= 0.5) & (F.col("best") < 0.7)).alias("medium"), F.count_if(F.col("best") < 0.5).alias("low"),
        *(F.avg(n).alias(f"avg_{n}") for n in s),
    )


def quality_statistics(issues: DataFrame, links: DataFrame, excluded: DataFrame) -> DataFrame:
    """(repo_id, total_closed, eligible, linked, links, avg_confidence); here a link of any confidence counts."""
    c = link_coverage(issues, links.withColumn("confidence", F.lit(1.0)), excluded)
    n = links.groupBy("repo_id").agg(F.count("*").alias("links"), F.avg("confidence").alias("avg_confidence"))
    zero = {"links": F.lit(0), "avg_confidence": F.lit(0.0)}
    return c.drop("unlinked").join(n, "repo_id", "left").withColumns({k: F.coalesce(k, v) for k, v in zero.items()})


def status(score: Column, steps: tuple[int, int, int]) -> Column:
    return F.when(score >= steps[0], "Excellent").when(score >= steps[1], "Good").when(score >= steps[2], "Fair").otherwise("Poor")


def rank(score: Column) -> Column:
    return F.when(score >= 90, "World-Class").when(score >= 80, "High Quality").when(score >= 70, "Moderate Quality").when(score >= 60, "Below Average").otherwise("Poor Quality")


def multiplier(score: Column, otherwise: float = 0.25) -> Column:
    return F.when(score >= 90, 1.0).when(score >= 80, 0.9).when(score >= 70, 0.75).when(score >= 60, 0.5).otherwise(otherwise)


def link_quality(issues: DataFrame, links: DataFrame, excluded: DataFrame, least_closed: int = 10) -> DataFrame:
    """One row for each repository of ``least_closed`` closed issues with one that needs a link: the five components (0 to
    100), their statuses, score, grade, rank and multiplier, and the figures that advice needs."""
    cover = link_coverage(issues, links, excluded).where((F.col("total_closed") >= least_closed) & (F.col("eligible") > 0))
    tiers = linking.confidence_quality(linking.confidence_tiers(links, ["repo_id"])).select("repo_id", F.col("quality").alias("confidence"), "low_n")
    kinds = evidence_diversity(links).select("repo_id", "avg_kinds", "bidirectional", "links")
    timed, strength = temporal_precision(links).select("repo_id", "timed", "tight"), semantic_strength(links).select("repo_id", "avg_max")
    j = cover
    for other in (tiers, kinds, timed, strength):  # all are grouped by repo_id, so the joins need no further shuffle
        j = j.join(other, "repo_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = {
        "coverage": F.col("linked") * 100.0 / F.col("eligible"), "confidence": zero(F.col("confidence")), "diversity": zero(F.col("avg_kinds")) / 6.0 * 100.0,
        "precision": zero(F.try_divide("tight", "timed")) * 100.0, "strength": zero(F.col("avg_max")) * 100.0,
    }
    out = j.select("repo_id", "total_closed", "eligible", "linked", "unlinked", *(zero(F.col(c)).cast("bigint").alias(c) for c in ("low_n", "bidirectional", "links")), zero(F.col("avg_kinds")).alias("avg_kinds"), *(v.alias(k) for k, v in parts.items()))
    score = linking.clqs([F.col(k) for k in WEIGHTS], tuple(WEIGHTS.values()))
    out = out.withColumn("score", score)
    return out.select("*", *(status(F.col(k), STATUS[k]).alias(f"{k}_status") for k in STATUS), linking.grade(F.col("score")).alias("grade"), rank(F.col("score")).alias("rank"), multiplier(F.col("score")).alias("multiplier"))


def advice(quality: DataFrame) -> DataFrame:
    """``quality`` (from link_quality) with advice array<struct<priority, category, impact>> in order of the components, and
    gain, what labelling the links of low confidence may add."""
    rate = F.col("coverage") / 100.0
    weakest = F.least(*[F.col(k) for k in WEIGHTS])
    rule = lambda on, category, impact: F.when(on, F.struct(F.lit(category).alias("category"), impact.alias("impact")))
    low = F.try_divide(F.col("low_n") * 100.0, F.col("links"))
    rules = F.array(
        rule(F.col("unlinked") > 0, "coverage", F.when(rate >= 0.9, "low").when(rate >= 0.8, "medium").otherwise("high")),
        rule(F.col("low_n") > 0, "confidence", F.when(low > 20, "high").otherwise("medium")),
        rule((F.col("links") > 0) & (F.col("avg_kinds") < 4), "diversity", F.lit("low")),
        rule((F.col("links") > 0) & (F.col("bidirectional") < F.floor(F.col("links") / 2)), "diversity", F.lit("low")),
        rule(F.col("precision") < 60, "precision", F.when(F.col("precision") < 40, "high").otherwise("medium")),
        rule(F.col("strength") < 70, "strength", F.lit("low")),
        rule(weakest < 70, "overall", F.lit("high")),
    )
    kept = F.transform(F.filter(rules, lambda x: x.isNotNull()), lambda x, i: F.struct((i + 1).alias("priority"), x["category"].alias("category"), x["impact"].alias("impact")))
    return quality.select("*", kept.alias("advice"), F.least(F.lit(5.0), F.col("low_n") * 0.05).alias("gain"))


def latest_scores(scores: DataFrame) -> DataFrame:
    """The newest (repo_id, score, computed_at) of each repository."""
    return scores.groupBy("repo_id").agg(F.max_by("score", "computed_at").alias("score"), F.max("computed_at").alias("computed_at"))


def graph_quality(issues: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, explicit, temporal, comment, semantic, bidirectional, score, grade, rank) by the evidence tags of edges.

    ``edges``: (repo_id, issue_number, evidence, semantic_score), links out of issues. The first three are shares of the
    closed issues that have such an edge, semantic the mean score of edges of closed issues, bidirectional a share of edges.
    """
    closed = issues.where("state = 'closed'").select("repo_id", F.col("number").alias("issue_number"))
    tagged = [k for k, (_, tags) in GRAPH_PARTS.items() if tags and k != "bidirectional"]
    of_issue = edges.groupBy("repo_id", "issue_number").agg(
        *(F.max(has_any(F.col("evidence"), GRAPH_PARTS[k][1]).cast("int")).alias(k) for k in tagged), F.sum("semantic_score").alias("s"), F.count("semantic_score").alias("n")
    )
    a = closed.join(of_issue, ["repo_id", "issue_number"], "left").groupBy("repo_id").agg(
        *((F.sum(F.coalesce(k, F.lit(0))) * 100.0 / F.count("*")).alias(k) for k in tagged), (F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)) * 100.0).alias("semantic")
    )
    b = edges.groupBy("repo_id").agg((F.count_if(has_any(F.col("evidence"), GRAPH_PARTS["bidirectional"][1])) * 100.0 / F.count("*")).alias("bidirectional"))
    out = a.join(b, "repo_id", "left").withColumn("bidirectional", F.coalesce("bidirectional", F.lit(0.0)))
    s = F.col("score")
    steps = ((95, "A+"), (90, "A"), (85, "A-"), (80, "B+"), (75, "B"), (70, "B-"), (65, "C+"), (60, "C"), (55, "C-"), (50, "D+"), (45, "D"))
    grade = F.lit("F")
    for at, g in reversed(steps):
        grade = F.when(s >= at, g).otherwise(grade)
    names = F.when(s >= 90, "World-Class").when(s >= 75, "High Quality").when(s >= 60, "Moderate Quality").when(s >= 45, "Below Average").otherwise("Poor Quality")
    out = out.withColumn("score", sum((F.col(k) * w for k, (w, _) in GRAPH_PARTS.items()), F.lit(0.0)))
    return out.select("repo_id", *GRAPH_PARTS, "score", grade.alias("grade"), names.alias("rank"))
