"""Issue and pull request links: candidates in time, confidence, lead times, link quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def within(left: DataFrame, right: DataFrame, tolerance_us: int = DAY_US) -> DataFrame:
    """(key, left_id, right_id, delta_us) with |delta| < tolerance, for ``left`` and ``right`` (key, id, at bigint), and any other
    columns of the two, which must have names of their own.

    The right rows go to the bands of width ``tolerance`` before, of and after theirs, so the join is an equi join on
    (key, band) that spreads one key over its bands.
    """
    band = lambda c: F.floor(F.col(c) / F.lit(tolerance_us)).cast("bigint")
    more = [[c for c in df.columns if c not in ("key", "id", "at")] for df in (left, right)]
    a = left.where("at IS NOT NULL").select("key", F.col("id").alias("left_id"), F.col("at").alias("left_at"), *more[0], band("at").alias("band"))
    b = right.where("at IS NOT NULL").select("key", F.col("id").alias("right_id"), F.col("at").alias("right_at"), *more[1], F.explode(F.array(band("at") - 1, band("at"), band("at") + 1)).alias("band"))
    delta = F.col("left_at") - F.col("right_at")
    return a.join(b, ["key", "band"]).where(F.abs(delta) < tolerance_us).select("key", "left_id", "right_id", delta.alias("delta_us"), *more[0], *more[1])


def nearest_k(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("key", "left_id").orderBy(F.abs("delta_us"), "right_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def temporal_confidence(delta_us: Column) -> Column:
    d = F.abs(delta_us)
    return F.when(d < 300_000_000, 0.75).when(d < 3_600_000_000, 0.65).when(d < DAY_US, 0.55).otherwise(0.0)


def temporal_boost(delta_us: Column) -> Column:
    d = F.abs(delta_us)
    return F.when(d < 300_000_000, 0.15).when(d < 3_600_000_000, 0.12).when(d < DAY_US, 0.08).when(d < 3 * DAY_US, 0.05).otherwise(0.0)


def semantic_boost(score: Column) -> Column:
    return F.when(score >= 0.7, 0.15).when(score >= 0.5, 0.10).when(score >= 0.3, 0.05).otherwise(0.0)


def temporal_pattern(delta_us: Column) -> Column:
    d = F.abs(delta_us)
    return F.when(d < 300_000_000, "simultaneous").when(delta_us < 0, "reverse").when(d < 3 * DAY_US, "normal").otherwise("delayed")


def final_confidence(base: Column, bidirectional: Column, semantic: Column, temporal: Column, penalty: Column) -> Column:
    return F.least(F.lit(0.98), base + bidirectional + semantic + temporal + penalty)


def temporal_tag(delta_us: Column) -> Column:
    """The evidence tag of a distance in time; null beyond a day."""
    d = F.abs(delta_us)
    return F.when(d < 300_000_000, "temporal_match_5min").when(d < 3_600_000_000, "temporal_match_1hr").when(d < DAY_US, "temporal_match_24hr")


def accepted(delta_us: Column, similarity: Column) -> Column:
    """struct<confidence, evidence> of a candidate in time and text, null if it is refused: nothing in common and an hour away
    or more, or a day away. Common words add to the confidence, 0.98 at most."""
    plus = F.when(similarity >= 0.20, 0.10).when(similarity >= 0.10, 0.05).otherwise(0.0)
    base, tag = temporal_confidence(delta_us), temporal_tag(delta_us)
    ok = (base > 0) & ((similarity >= 0.10) | (F.abs(delta_us) < 3_600_000_000))
    tags = F.when(plus > 0, F.array(tag, F.lit("semantic_boost"))).otherwise(F.array(tag))
    return F.when(ok, F.struct(F.when(plus > 0, F.least(base + plus, F.lit(0.98))).otherwise(base).alias("confidence"), tags.alias("evidence")))


def time_boosted(confidence: Column, delta_us: Column) -> Column:
    """0.15, 0.10 or 0.05 more for 5 minutes, an hour, a day; 0.98 at most; no time, no change but the cap."""
    d = F.abs(delta_us)
    plus = F.when(d < 300_000_000, 0.15).when(d < 3_600_000_000, 0.10).when(d < DAY_US, 0.05).otherwise(0.0)
    return F.when(delta_us.isNull(), confidence).otherwise(F.least(confidence + plus, F.lit(0.98)))


#: What a commenter's role adds (fixed values).
ROLE_BOOSTS = {"owner": 0.10, "collaborator": 0.08, "bot": 0.05, "contributor": 0.03}


def commenter_role(author: Column, owner: Column, collaborators: Column, is_bot: Column) -> Column:
    return F.when(is_bot, "bot").when(author == owner, "owner").when(F.coalesce(F.array_contains(collaborators, author), F.lit(False)), "collaborator").otherwise("contributor")


def role_boosted(confidence: Column, role: Column) -> Column:
    plus = F.lit(0.0)
    for r, b in ROLE_BOOSTS.items():
        plus = F.when(role == r, b).otherwise(plus)
    return F.least(confidence + plus, F.lit(0.98))


def evidence_boosted(confidence: Column, tags: Column) -> Column:
    """0.03 more for each distinct tag after the first; 0.98 at most."""
    n = F.coalesce(F.size(F.array_distinct(tags)), F.lit(0))
    return F.least(confidence + F.greatest(n - 1, F.lit(0)) * 0.03, F.lit(0.98))


def checked_reference(message: Column, number: Column, confidence: Column) -> Column:
    """The confidence of a reference found in a commit message: unchanged if the message names the number, else 0.3 of it, and
    null under 0.2 then or for a merge of a pull request."""
    low, n = F.lower(F.coalesce(message, F.lit(""))), number.cast("string")
    named = low.contains(F.concat(F.lit("#"), n))
    for p in ("pr ", "pr#", "issue ", "issue#"):
        named = named | low.contains(F.concat(F.lit(p), n))
    weak = confidence * 0.3
    return F.when(F.coalesce(message.startswith("Merge pull request"), F.lit(False)), None).when(named, confidence).when(weak >= 0.2, weak)


def evidence_of(base: Column, bidirectional: Column, semantic: Column, temporal: Column) -> Column:
    """The names of the parts of a confidence that are above 0, in order."""
    parts = (("explicit", base), ("bidirectional", bidirectional), ("semantic", semantic), ("temporal", temporal))
    return F.filter(F.array(*[F.when(c > 0, F.lit(n)) for n, c in parts]), lambda x: x.isNotNull())


def needs_review(confidence: Column, least: float = 0.5) -> Column:
    return confidence < least


def reverse(delta_us: Column) -> Column:
    """Whether the merge came after the closing."""
    return delta_us < 0


def quality(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.70, "medium").otherwise("low")


def lead_times(pulls: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """(by, n, median_hours, insufficient, window_days): exact median of creation to merge and the activity window it gives."""
    h = (micros(F.col("merged_at")) - micros(F.col("created_at"))) / F.lit(3.6e9)
    g = pulls.where("merged_at IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.percentile(h, F.lit(0.5)).alias("median_hours"))
    few = F.col("n") < least
    days = F.when(few, 90).when(F.col("median_hours") < 24, 30).when(F.col("median_hours") < 72, 45).when(F.col("median_hours") < 168, 60).otherwise(90)
    return g.withColumn("insufficient", few).withColumn("window_days", days)


def link_window_hours(n: Column, lead_hours: Column) -> Column:
    return F.when(n < 10, 72).otherwise(F.floor(F.greatest(F.lit(36.0), F.least(lead_hours * 0.75, F.lit(168.0)))).cast("int"))


def confidence_tiers(links: DataFrame, by: list[str]) -> DataFrame:
    c = F.col("confidence")
    tier = {"high": c >= 0.85, "medium": (c >= 0.7) & (c < 0.85), "low": c < 0.7}
    aggs = [x for t, p in tier.items() for x in (F.count_if(p).alias(f"{t}_n"), F.coalesce(F.avg(F.when(p, c)), F.lit(0.0)).alias(f"{t}_avg"))]
    return links.groupBy(*by).agg(*aggs)


def confidence_quality(tiers: DataFrame) -> DataFrame:
    """Weighted mean confidence, the tiers weighing 1, 0.7 and 0.3."""
    w = {"high": 1.0, "medium": 0.7, "low": 0.3}
    total = sum(F.col(f"{t}_n") * F.col(f"{t}_avg") * x for t, x in w.items())
    return tiers.withColumn("quality", F.coalesce(F.try_divide(total, sum(F.col(f"{t}_n") * x for t, x in w.items())), F.lit(0.0)) * 100.0)


def clqs(parts: list[Column], weights: tuple[float, ...] = (0.40, 0.35, 0.15, 0.05, 0.05)) -> Column:
    return sum((p * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0))


def grade(score: Column) -> Column:
    """Letter of a link-quality score."""
    steps = ((97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (63, "D"), (60, "D-"))
    out = F.when(score >= steps[0][0], steps[0][1])
    for at, g in steps[1:]:
        out = out.when(score >= at, g)
    return out.otherwise("F")


def case_verdict(expected_pulls: Column, expected_shas: Column, found_pulls: Column, found_shas: Column, expected_miss: Column) -> Column:
    """PASS if an expected pull request is found or an expected commit by its first 7 characters, EXPECTED_MISS if none was to be
    found there, else FAIL."""
    seven = lambda a: F.transform(a, lambda x: F.substring(F.lower(x), 1, 7))
    off = F.lit(False)
    hit = F.coalesce(F.arrays_overlap(expected_pulls, found_pulls), off) | F.coalesce(F.arrays_overlap(seven(expected_shas), seven(found_shas)), off)
    return F.when(hit, "PASS").when(F.coalesce(expected_miss, off), "EXPECTED_MISS").otherwise("FAIL")


def pattern_metrics(cases: DataFrame) -> DataFrame:
    """(pattern, cases, found, rate, confidence) of (patterns array<string>, found, confidence); a case counts once for each pattern."""
    p = cases.select(F.explode(F.array_distinct("patterns")).alias("pattern"), "found", "confidence")
    g = p.groupBy("pattern").agg(F.count("*").alias("cases"), F.count_if("found").alias("found"), F.coalesce(F.avg(F.when(F.col("found"), F.col("confidence"))), F.lit(0.0)).alias("confidence"))
    return g.withColumn("rate", F.col("found") / F.col("cases"))


def matcher_metrics(expected: DataFrame, detected: DataFrame, keys: list[str], least: float = 0.6) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of detected (keys, confidence) against expected (keys); only what has ``least``
    confidence counts as wrong."""
    e, d = expected.select(*keys).distinct().withColumn("e", F.lit(1)), detected.groupBy(*keys).agg(F.max("confidence").alias("confidence"))
    j = e.join(d, keys, "full")
    g = j.agg(F.count_if(F.col("e").isNotNull() & F.col("confidence").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull() & (F.col("confidence") >= least)).alias("fp"), F.count_if(F.col("confidence").isNull()).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2.0 * p * r, p + r))


def verdict_metrics(cases: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy of (expected boolean, found boolean)."""
    e, f = F.col("expected"), F.col("found")
    g = cases.agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"), F.count_if(~e & ~f).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2.0 * p * r, p + r)).withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
