"""Relevance routing and level checks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmark.operators.joins import lookup_join, salted_join
from levelmark.operators.taxonomy import level_pairs, topic_keys

# The two relevance flags.
IN_SECTOR = "In Sector"
NOT_IN_SECTOR = "Not in sector"


def flag_relevance(listing: DataFrame, framework: DataFrame, salt_by: list[str], **bounds) -> DataFrame:
    """Adds `relevance`: does the sector's framework define the skill?"""
    keys = topic_keys(framework).withColumn("_known", F.lit(True))
    flagged = lookup_join(listing, keys, ["skill_key"], "left", salt_by, **bounds)
    flag = F.when(F.col("_known"), IN_SECTOR).otherwise(NOT_IN_SECTOR)
    return flagged.withColumn("relevance", flag).drop("_known")


def relevant_rows(listing: DataFrame, framework: DataFrame, salt_by: list[str], **bounds) -> DataFrame:
    return lookup_join(listing, topic_keys(framework), ["skill_key"], "left_semi", salt_by, **bounds)


def irrelevant_rows(listing: DataFrame, framework: DataFrame, salt_by: list[str], **bounds) -> DataFrame:
    return lookup_join(listing, topic_keys(framework), ["skill_key"], "left_anti", salt_by, **bounds)


def check_level(rows: DataFrame, pairs: DataFrame, level: str, ok: str, salt_by: list[str], **bounds) -> DataFrame:
    """Adds boolean `ok`: is `level` one the framework defines for the skill?"""
    allowed = pairs.select("skill_key", F.col("level").alias(level), F.lit(True).alias(ok))
    checked = lookup_join(rows, allowed, ["skill_key", level], "left", salt_by, **bounds)
    return checked.withColumn(ok, F.coalesce(F.col(ok), F.lit(False)))


def level_violations(tagged: DataFrame, framework: DataFrame, level: str = "level", **bounds) -> DataFrame:
    """Distinct (skill_key, level) tagged although not defined for the skill."""
    used = tagged.select("skill_key", F.col(level).alias("level")).distinct()
    return lookup_join(used, level_pairs(framework), ["skill_key", "level"], "left_anti", ["skill_key", "level"], **bounds)


def join_answers(
    rows: DataFrame, answers: DataFrame, on: list[str], how: str, salt_by: list[str], hot_rows: int | None = None
) -> DataFrame:
    """Rows to their answers; copies of one content may be most of the rows."""
    return salted_join(rows, answers, on, how, salt_by, hot_rows=hot_rows)
