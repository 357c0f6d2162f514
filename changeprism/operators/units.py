"""Reads over code units and files: listings with risk columns, histories over renames, file metrics and their classes.

``units`` is (repo_id, block, name, file, kind, start_line); ``changes`` (repo_id, block, sha, author, at); ``hits`` (repo_id,
block, issue, at). Every key holds repo_id, so a filter on it reaches the scan of tables partitioned by repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeprism.operators.ownership import days_since
from changeprism.operators.tables import reach

UNIT = ["repo_id", "block"]
#: Thresholds of the file metrics (fixed values).
COUPLING_STEPS, COCHANGE_STEPS, RATIO_STEPS = (5, 10), (0.3, 0.7), (0.8, 0.3)


def with_risk(units: DataFrame, changes: DataFrame, hits: DataFrame, as_of: Column) -> DataFrame:
    """``units`` with incidents, last_modifier, last_at, staleness_days; a unit without changes has no modifier."""
    last = changes.groupBy(*UNIT).agg(F.max(F.struct("at", "sha", "author")).alias("l"))
    n = hits.groupBy(*UNIT).agg(F.count("*").alias("n"))
    j = units.join(last, UNIT, "left").join(n, UNIT, "left")
    return j.select(*units.columns, F.coalesce("n", F.lit(0)).alias("incidents"), F.col("l.author").alias("last_modifier"), F.col("l.at").alias("last_at"), days_since(F.col("l.at"), as_of).alias("staleness_days"))


def of_file(units: DataFrame, file: str) -> DataFrame:
    return units.where(F.col("file") == file).orderBy("start_line", "block")


def in_folder(units: DataFrame, folder: str) -> DataFrame:
    return units.where(F.col("file").startswith(folder))


def of_names(units: DataFrame, names: list[str], files: list[str]) -> DataFrame:
    return units.where(F.col("name").isin(*names) & F.col("file").isin(*files))


def lookup(units: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Units whose name begins with ``text`` (rank 1) or holds it (2), whatever the case; by rank, name and unit."""
    low = F.lower("name")
    rank = F.when(low.startswith(text.lower()), 1).when(low.contains(text.lower()), 2)
    return units.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "name", *UNIT).limit(k)


def ownership_overview(units: DataFrame) -> DataFrame:
    """(repo_id, units, critical, medium, low, stale, bus_warnings) of units with risk_score, staleness_days, concentration."""
    r = F.col("risk_score")
    return units.groupBy("repo_id").agg(
        F.count("*").alias("units"), F.count_if(r > 70).alias("critical"), F.count_if((r >= 40) & (r <= 70)).alias("medium"), F.count_if(r < 40).alias("low"),
        F.count_if(F.col("staleness_days") > 90).alias("stale"), F.count_if(F.col("concentration") >= 70).alias("bus_warnings"),
    )


def last_or_first_author(units: DataFrame, changes: DataFrame) -> DataFrame:
    """(repo_id, block, modifier): the author of the last change, else of the commit that made the unit (creator)."""
    last = changes.groupBy(*UNIT).agg(F.max(F.struct("at", "sha", "author"))["author"].alias("modifier"))
    return units.join(last, UNIT, "left").select(*UNIT, F.coalesce("modifier", "creator").alias("modifier"))


def incidents_of_units(hits: DataFrame, issues: DataFrame) -> DataFrame:
    """``hits`` with title and state of their issue; incidents whose issue is gone stay."""
    return hits.join(issues.select("repo_id", F.col("number").alias("issue"), "title", "state"), ["repo_id", "issue"], "left")


def ownership_history(changes: DataFrame, as_of: Column, active_days: int, least: int = 2, k: int = 10) -> DataFrame:
    """(repo_id, file, author, commits, last_at, days, active, rank) of authors with ``least`` changes of a file (repo_id, file,
    sha, author, at), the ``k`` with most."""
    n = changes.groupBy("repo_id", "file", "author").agg(F.count("*").alias("commits"), F.max("at").alias("last_at")).where(F.col("commits") >= least)
    w = Window.partitionBy("repo_id", "file").orderBy(F.desc("commits"), "author")
    days = days_since(F.col("last_at"), as_of)
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("repo_id", "file", "author", "commits", "last_at", days.alias("days"), (days < active_days).alias("active"), "rank")


def recent_changes(changes: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """The ``k`` newest changes of each group, ties by sha."""
    w = Window.partitionBy(*by).orderBy(F.desc("at"), "sha")
    return changes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def collected_metrics(recent: DataFrame, changes: DataFrame, hits: DataFrame) -> DataFrame:
    """(repo_id, file, complexity, density, churn): lines of the newest change by 100 (1 at most), incidents for each 100
    commits, and lines of the newest changes by 500 (1 at most). ``recent``: recent_changes with additions and deletions."""
    lines = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    r = recent.groupBy("repo_id", "file").agg(F.max(F.when(F.col("rank") == 1, lines)).alias("newest"), F.sum(lines).alias("lines"))
    c = changes.groupBy("repo_id", "file").agg(F.countDistinct("sha").alias("commits"))
    i = hits.groupBy("repo_id", "file").agg(F.count("*").alias("incidents"))
    cap = lambda x: F.least(F.lit(1.0), x)
    j = c.join(r, ["repo_id", "file"], "left").join(i, ["repo_id", "file"], "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    return j.select("repo_id", "file", cap(zero("newest") / 100.0).alias("complexity"), (zero("incidents") * 100.0 / F.col("commits")).alias("density"), cap(zero("lines") / 500.0).alias("churn"))


def coupling_class(count: Column) -> Column:
    return F.when(count <= COUPLING_STEPS[0], "LOW").when(count <= COUPLING_STEPS[1], "MEDIUM").otherwise("HIGH")


def cochange_class(frequency: Column) -> Column:
    return F.when(frequency <= COCHANGE_STEPS[0], "LOW").when(frequency <= COCHANGE_STEPS[1], "MEDIUM").otherwise("HIGH")


def ratio_class(ratio: Column) -> Column:
    return F.when(ratio >= RATIO_STEPS[0], "LOW").when(ratio >= RATIO_STEPS[1], "MEDIUM").otherwise("HIGH")


def frequency_of_count(count: Column) -> Column:
    """A stand-in for a frequency where only a count of partners is known."""
    return F.when(count == 0, 0.0).when(count <= 2, 0.2).when(count <= 5, 0.5).otherwise(0.8)


def overall_risk(coupling: Column, cochange: Column, ratio: Column) -> Column:
    """HIGH if a metric escalates (coupling over 10, co-change over 0.7, ratio under 0.3), else the highest class; a metric
    that is null has no say."""
    off = F.lit(False)
    up = F.coalesce(coupling > 10, off) | F.coalesce(cochange > 0.7, off) | F.coalesce(ratio < 0.3, off)
    classes = [F.when(x.isNotNull(), f(x)) for f, x in ((coupling_class, coupling), (cochange_class, cochange), (ratio_class, ratio))]
    has = lambda level: sum((F.coalesce((c == level).cast("int"), F.lit(0)) for c in classes), F.lit(0)) > 0
    return F.when(up | has("HIGH"), "HIGH").when(has("MEDIUM"), "MEDIUM").otherwise("LOW")


def baseline_risk(incidents: Column, coupling: Column) -> Column:
    return F.when((incidents >= 3) | (coupling > 0.8), "HIGH").when((incidents >= 1) | (coupling > 0.5), "MEDIUM").otherwise("LOW")


def change_size(lines: Column) -> Column:
    return F.when(lines > 100, "LARGE").when(lines > 30, "MEDIUM").otherwise("SMALL")


def churn_class(changes: Column, days_since_transition: Column) -> Column:
    """HIGH over 10 changes, or over 5 with a transition less than 30 days ago; MEDIUM over 5."""
    recent = F.coalesce((days_since_transition >= 0) & (days_since_transition < 30), F.lit(False))
    return F.when((changes > 10) | ((changes > 5) & recent), "HIGH").when(changes > 5, "MEDIUM").otherwise("LOW")


def churn_report(changes: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """(repo_id, block, changes, days_since_last, class) of the changes in the last ``days`` days."""
    age = days_since(F.col("at"), as_of)
    g = changes.withColumn("age", age).where(F.col("age").between(0, days)).groupBy(*UNIT).agg(F.count("*").alias("changes"), F.min("age").alias("days_since_last"))
    return g.withColumn("class", churn_class(F.col("changes"), F.col("days_since_last")))


def hotspot_score(coupling: Column, ratio: Column, cochange: Column) -> Column:
    """0 to 1: up to 0.3 for coupling, 0.3 for missing tests, 0.4 for co-change; null metrics add nothing."""
    a = F.when(coupling > 15, 0.3).when(coupling > 10, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), a + F.coalesce((1.0 - ratio) * 0.3, F.lit(0.0)) + F.coalesce(cochange * 0.4, F.lit(0.0)))


def reputation(coupling: Column, ratio: Column, cochange: Column) -> Column:
    """1 less up to 0.3 for missing tests, 0.3 for coupling (all at 20) and 0.2 for co-change; 0 at least."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.greatest(F.lit(0.0), 1.0 - zero((1.0 - ratio) * 0.3) - zero(F.least(coupling / 20.0, F.lit(1.0)) * 0.3) - zero(cochange * 0.2))


def display_score(level: Column) -> Column:
    return F.when(level == "HIGH", 8.0).when(level == "MEDIUM", 5.0).when(level == "LOW", 2.0).otherwise(0.0)


def evidence_score(evidence: DataFrame, by: str) -> DataFrame:
    """(by, score): mean severities of incident, co_change and ownership evidence (by, kind, severity) by 0.5, 0.3 and 0.2, at
    most 1; a kind without evidence counts 0."""
    mean = lambda k: F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("severity"))), F.lit(0.0))
    return evidence.groupBy(by).agg(F.least(F.lit(1.0), mean("incident") * 0.5 + mean("co_change") * 0.3 + mean("ownership") * 0.2).alias("score"))


def versions(renames: DataFrame, units: DataFrame, hops: int = 5) -> DataFrame:
    """(repo_id, block, version): each unit with itself and its former versions of (repo_id, block, former)."""
    pair = lambda c, n: F.struct(F.col("repo_id"), F.col(c).alias("block")).alias(n)
    back = reach(renames.select(pair("block", "src"), pair("former", "dst")), hops)
    own = units.select(*UNIT).distinct()
    return own.select(*UNIT, F.col("block").alias("version")).unionByName(back.select("src.repo_id", "src.block", F.col("dst.block").alias("version")))


def incident_risk(versions_: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """(repo_id, block, incidents, last_at, affected): of the ``k`` newest distinct incidents of a unit's versions, how many
    there are, the newest time and the versions they touched."""
    j = versions_.join(hits.select("repo_id", F.col("block").alias("version"), "issue", "at"), ["repo_id", "version"]).groupBy(*UNIT, "issue", "version").agg(F.max("at").alias("at"))
    w = Window.partitionBy(*UNIT).orderBy(F.desc("at"), "issue", "version")
    top = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.groupBy(*UNIT).agg(F.count("*").alias("incidents"), F.max("at").alias("last_at"), F.countDistinct("version").alias("affected"))


def ownership_risk(versions_: DataFrame, changes: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    """(repo_id, block, most_active, least_active, contributors, days, few): over a unit's versions, the first and the last of
    the ``k`` authors with most changes, days since the change of the first, and whether two authors or fewer know it."""
    j = versions_.join(changes.select("repo_id", F.col("block").alias("version"), "author", "sha", "at"), ["repo_id", "version"])
    n = j.groupBy(*UNIT, "author").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    w = Window.partitionBy(*UNIT).orderBy(F.desc("n"), "author")
    top = n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    g = top.groupBy(*UNIT).agg(F.min_by("author", "rank").alias("most_active"), F.max_by("author", "rank").alias("least_active"), F.min_by("last_at", "rank").alias("at"), F.count("*").alias("contributors"))
    return g.select(*UNIT, "most_active", "least_active", "contributors", days_since(F.col("at"), as_of).alias("days"), (F.col("contributors") <= 2).alias("few"))


def dynamic_coupling(rate: Column, incidents_a: Column, incidents_b: Column, last_at: Column, as_of: Column) -> Column:
    """Rate by the incidents of both, more for a recent common change."""
    d = days_since(last_at, as_of)
    return rate * (incidents_a + incidents_b) * F.when(d < 90, 1.5).when(d < 180, 1.0).otherwise(0.5)


def coupling_risk(pairs: DataFrame, incidents: DataFrame, as_of: Column, min_rate: float = 0.75, k: int = 3) -> DataFrame:
    """(block, score, partners): the ``k`` greatest dynamic couplings with units that had an incident, added up.

    ``pairs``: (a, b, rate, last_at); ``incidents``: (block, incidents).
    """
    both = pairs.select(F.col("a").alias("block"), F.col("b").alias("other"), "rate", "last_at").unionByName(pairs.select(F.col("b").alias("block"), F.col("a").alias("other"), "rate", "last_at"))
    n = lambda c, out: incidents.select(F.col("block").alias(c), F.col("incidents").alias(out))
    j = both.where(F.col("rate") >= min_rate).join(n("block", "ia"), "block").join(n("other", "ib").where("ib >= 1"), "other")
    s = j.withColumn("score", dynamic_coupling(F.col("rate"), F.col("ia"), F.col("ib"), F.col("last_at"), as_of))
    w = Window.partitionBy("block").orderBy(F.desc("score"), "other")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("block").agg(F.sum("score").alias("score"), F.count("*").alias("partners"))


def change_history(versions_: DataFrame, changes: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` newest changes of each unit over all its versions: (repo_id, block, version, sha, author, at, rank)."""
    j = versions_.join(changes.select("repo_id", F.col("block").alias("version"), "sha", "author", "at").distinct(), ["repo_id", "version"])
    w = Window.partitionBy(*UNIT).orderBy(F.desc("at"), "sha", "version")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*UNIT, "version", "sha", "author", "at", "rank")


def by_overlap(changed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(key, candidate, confidence) of the candidate (key, candidate, position, start_line, end_line) with most changed lines
    (key, line) in it: the first on a tie, 0.5 at least; without changed lines the first with 0.5.

    Lines are counted for each candidate after an equi join on the key and a compact array of the changed lines.
    """
    lines = changed.groupBy("key").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    inside = F.size(F.filter("lines", lambda x: (x >= F.col("start_line")) & (x <= F.col("end_line"))))
    j = candidates.join(lines, "key", "left").withColumn("overlap", F.coalesce(F.when(F.col("lines").isNotNull(), inside), F.lit(0))).withColumn("total", F.coalesce(F.size("lines"), F.lit(0)))
    w = Window.partitionBy("key").orderBy(F.desc("overlap"), "position", "candidate")
    best = j.withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return best.select("key", "candidate", F.greatest(F.lit(0.5), F.coalesce(F.try_divide(F.col("overlap").cast("double"), F.col("total")), F.lit(0.5))).alias("confidence"))
