"""Where a model may be asked: extraction of references, classification of closed issues and ranking of candidates take a
function from DataFrame to DataFrame; the default of each is a rule, so results are the same on every run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeprism.functions import text
from changeprism.operators import review, summary

Extractor = Callable[[DataFrame], DataFrame]


def references_by_rule(texts: DataFrame) -> DataFrame:
    """(id, number, kind, confidence): every number that a closing word points to, and how the text speaks of it."""
    e = texts.select("id", "title", "body", F.explode(text.issue_references(F.col("title"), F.col("body"))).alias("number"))
    whole = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    kind = review.reference_type(whole, F.col("number"))
    return e.select("id", "number", kind.alias("kind"), F.when(kind == "fixes", 0.9).otherwise(0.6).alias("confidence"))


#: Words of a closing comment or label by class, in the order in which they are tried (fixed values).
CLOSURES = {"duplicate": ("duplicate",), "wontfix": ("wontfix", "won't fix"), "not_a_bug": ("not a bug", "works as intended"), "user_action_required": ("needs info", "no response")}


def closures_by_rule(issues: DataFrame) -> DataFrame:
    """(id, classification, confidence) of (id, labels, comment): the first class of which a word occurs, else fixed_with_code."""
    whole = F.lower(F.concat_ws(" ", F.coalesce("labels", F.lit("")), F.coalesce("comment", F.lit(""))))
    kind = F.lit("fixed_with_code")
    for name, words in reversed(CLOSURES.items()):
        for w in words:
            kind = F.when(whole.contains(w), name).otherwise(kind)
    return issues.select("id", kind.alias("classification"), F.when(kind == "fixed_with_code", 0.5).otherwise(0.9).alias("confidence"))


def extract_references(texts: DataFrame, extractor: Extractor = references_by_rule) -> DataFrame:
    return extractor(texts)


def classify_closures(issues: DataFrame, extractor: Extractor = closures_by_rule) -> DataFrame:
    return extractor(issues)


def rank(pairs: DataFrame, extractor: Extractor = summary.rank_candidates) -> DataFrame:
    return extractor(pairs)
