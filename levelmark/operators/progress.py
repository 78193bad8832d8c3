"""Counts, progress and remaining time of a run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelmark.operators.scoring import CALLS_PER_PAUSE, PAUSE_SECONDS

# Time per row before a rate is known, and the sentences below.
GUESS_SECONDS = 0.6


def run_counts(work: DataFrame, by: list[str]) -> DataFrame:
    """Total, done and pending rows; `done` is a boolean column."""
    return work.groupBy(*by).agg(
        F.count("*").alias("n_total"),
        F.count_if("done").alias("n_done"),
        F.count_if(~F.col("done")).alias("n_pending"),
    )


def progress(done: Column, total: Column) -> Column:
    return done / F.nullif(total, F.lit(0))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left: rate without pauses, plus the pauses still to come."""
    left = total - done
    full_blocks = F.floor(done / CALLS_PER_PAUSE)
    working = elapsed - full_blocks * PAUSE_SECONDS
    to_boundary = CALLS_PER_PAUSE - done % CALLS_PER_PAUSE
    pauses = F.when(left <= to_boundary, 0).otherwise(1 + F.floor((left - to_boundary) / CALLS_PER_PAUSE))
    known = F.when(working > 0, left * working / F.nullif(done, F.lit(0)) + pauses * PAUSE_SECONDS)
    unknown = F.when(done > 0, left * GUESS_SECONDS).otherwise(
        total * GUESS_SECONDS + F.floor(total / CALLS_PER_PAUSE) * PAUSE_SECONDS
    )
    return F.coalesce(F.when(done > 0, known), unknown)


def eta_text(seconds: Column) -> Column:
    def plural(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, "s").otherwise(""))

    hours = F.floor(seconds / 3600).cast("bigint")
    rest = F.floor(seconds % 3600 / 60).cast("bigint")
    minutes = F.floor(seconds / 60 + 0.5).cast("bigint")
    with_hours = F.concat(
        F.lit("About "),
        plural(hours, "hour"),
        F.when(rest > 0, F.concat(F.lit(" and "), plural(rest, "minute"))).otherwise(""),
        F.lit(" remaining"),
    )
    return (
        F.when(seconds > 3600, with_hours)
        .when(seconds > 60, F.concat(F.lit("About "), plural(minutes, "minute"), F.lit(" remaining")))
        .otherwise("Less than 1 minute remaining")
    )
