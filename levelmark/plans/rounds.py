"""The two tagging rounds as plans over DataFrames.

Buckets: irrelevant, pending, r1_valid, r1_invalid, then r2_valid, r2_invalid
and r2_untagged. Published: valid, invalid, all_tagged.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelmark.functions.answers import parse_round1, parse_round2
from levelmark.functions.text import content_id, course_text
from levelmark.operators.listing import attach_descriptions, dedupe_then_drop, with_skill_key
from levelmark.operators.routing import IN_SECTOR, check_level, flag_relevance, join_answers
from levelmark.operators.taxonomy import level_pairs
from levelmark.schemas import DESCRIPTION_COLUMNS

REQUIRED = ["course_ref", "skill_title", *DESCRIPTION_COLUMNS]
WORK_KEY = ["course_ref", "skill_key"]
#: Bytes of an id that is not hashed: fewer than a hash has.
SHORT_ID = 64


def prepare_work(
    listing: DataFrame,
    framework: DataFrame,
    order: list[str],
    required: list[str] = REQUIRED,
    title: str = "skill_key",
    **bounds,
) -> DataFrame:
    """Clean rows with key, relevance flag and `work_id`.

    Deduped on the normalised key, so that titles differing in case or edge
    spaces do not multiply in later joins; `title="skill_title"` dedupes on
    the raw title.
    """
    clean = dedupe_then_drop(with_skill_key(listing), required, order, title)
    flagged = flag_relevance(clean, framework, salt_by=["course_ref", title], **bounds)
    return flagged.withColumn("work_id", work_identity(F.col("course_ref").cast("string"), F.col(title)))


def work_identity(course: Column, title: Column) -> Column:
    """Course and title as they are where they are short, else their hash: a hash
    does not shrink, and every table and shuffle of a run holds the id."""
    identity = F.concat_ws("\x1f", course, title)
    short = course.isNotNull() & title.isNotNull() & (F.octet_length(identity) < SHORT_ID)
    return F.when(short, identity).otherwise(F.sha2(identity, 256))


def tag_round1(work: DataFrame, answers: DataFrame, framework: DataFrame, **bounds) -> DataFrame:
    """Adds level, reason, confidence and bucket from raw answer text."""
    parsed = answers.select("work_id", parse_round1(F.col("answer")).alias("_a"))
    # work_id is unique on both sides: no key can be hot.
    joined = work.join(parsed.select("work_id", "_a.*", F.lit(True).alias("_answered")), "work_id", "left")
    return bucket_round1(joined, framework, F.col("_answered").isNull(), **bounds).drop("_answered")


def bucket_round1(rows: DataFrame, framework: DataFrame, unanswered: Column, **bounds) -> DataFrame:
    checked = check_level(rows, level_pairs(framework), "level", "_ok", salt_by=["course_ref"], **bounds)
    bucket = (
        F.when(F.col("relevance") != IN_SECTOR, "irrelevant")
        .when(unanswered, "pending")
        .when(F.col("_ok"), "r1_valid")
        .otherwise("r1_invalid")
    )
    return checked.withColumn("bucket", bucket).drop("_ok")


def round2_work(failed: DataFrame, descriptions: DataFrame, hot: DataFrame | None = None, join=None) -> DataFrame:
    """Failed rows with the course's first description, text and content id."""
    described = attach_descriptions(failed, descriptions, salt_by=["work_id"], hot=hot, join=join)
    text = course_text(*[F.col(c) for c in DESCRIPTION_COLUMNS])
    return described.withColumn("course_text", text).withColumn(
        "unique_id", content_id(F.col("course_text"), F.col("skill_title"))
    )


def tag_round2(work: DataFrame, answers: DataFrame, framework: DataFrame, **bounds) -> DataFrame:
    """Adds level2, reason2, confidence2 and the bucket of round two."""
    parsed = answers.select(F.col("work_id").alias("unique_id"), parse_round2(F.col("answer")).alias("_a"))
    fields = parsed.select(
        "unique_id",
        F.col("_a.level").alias("level2"),
        F.col("_a.reason").alias("reason2"),
        F.col("_a.confidence").alias("confidence2"),
    )
    joined = join_answers(work.drop("bucket"), fields, ["unique_id"], "left", salt_by=["work_id"])
    return bucket_round2(joined, framework, **bounds)


def bucket_round2(rows: DataFrame, framework: DataFrame, **bounds) -> DataFrame:
    checked = check_level(rows, level_pairs(framework), "level2", "_ok", salt_by=["course_ref"], **bounds)
    bucket = (
        F.when(F.col("level2").isNull(), "pending")
        .when(F.col("level2") == 0, "r2_untagged")
        .when(F.col("_ok"), "r2_valid")
        .otherwise("r2_invalid")
    )
    return checked.withColumn("bucket", bucket).drop("_ok")


def promote(rows: DataFrame) -> DataFrame:
    """Round-two level, reason and confidence replace those of round one."""
    return rows.withColumns(
        {
            "level": F.coalesce("level2", "level"),
            "reason": F.coalesce("reason2", "reason"),
            "confidence": F.coalesce("confidence2", "confidence"),
        }
    ).drop("level2", "reason2", "confidence2")


def published(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Rows of the three published results, told apart by `bucket`; one pass
    over each round."""
    results = (
        F.when(F.col("bucket") == "r2_valid", F.array(F.lit("valid"), F.lit("all_tagged")))
        .when(F.col("bucket").isin("r2_invalid", "r2_untagged"), F.array(F.lit("invalid")))
    )
    second = r2.withColumn("bucket", F.explode(results))
    for name in ("level", "reason", "confidence"):
        # In "all_tagged" the second answer takes the place of the first.
        tagged = F.col("bucket") == "all_tagged"
        second = second.withColumn(name, F.when(tagged, F.col(f"{name}2")).otherwise(F.col(name)))
        second = second.withColumn(f"{name}2", F.when(~tagged, F.col(f"{name}2")))
    first = r1.where(F.col("bucket") == "r1_valid").withColumn("bucket", F.lit("all_tagged"))
    return first.unionByName(second, allowMissingColumns=True)
