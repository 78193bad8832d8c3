"""Joins that stay even under hot keys and broadcast only what was measured."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Defaults of the session settings of the same names.
SETTINGS = {
    "spark.levelmark.broadcastRows": 1_000_000,
    "spark.levelmark.broadcastBytes": 64 * 1024 * 1024,
    "spark.levelmark.hotRows": 1_000_000,
    "spark.levelmark.salts": 64,
    "spark.levelmark.taskRows": 250_000,
}


def setting(spark: SparkSession, name: str, value: int | None = None) -> int:
    """The given value, else the session's, else the default."""
    if value is not None:
        return value
    key = f"spark.levelmark.{name}"
    return int(spark.conf.get(key, str(SETTINGS[key])))


def row_bytes(df: DataFrame):
    """Estimated size of a row: text by its length, everything else flat."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            total = total + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) + 32
        else:
            total = total + 8
    return total


def within_limits(spark: SparkSession, rows: int, size: int, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    return rows <= setting(spark, "broadcastRows", max_rows) and size <= setting(spark, "broadcastBytes", max_bytes)


def fits_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Measures rows and bytes in one job; a single row comes back."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    return within_limits(df.sparkSession, size["n"], size["b"], max_rows, max_bytes)


def partitions_for(spark: SparkSession, rows: int) -> int:
    """At least as many partitions as a shuffle has and the session cores, and so
    many more that one holds few rows: what a task sorts and gathers does not grow
    with the table."""
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, -(-rows // setting(spark, "taskRows")))


def hot_keys(df: DataFrame, on: list[str], hot_rows: int | None = None) -> DataFrame:
    """Keys with more than `hot_rows` rows: at most rows / hot_rows of them."""
    hot_rows = setting(df.sparkSession, "hotRows", hot_rows)
    counts = df.groupBy(*on).agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") > hot_rows).select(*on, F.lit(True).alias("_hot"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    salt_by: list[str],
    hot: DataFrame | None = None,
    hot_rows: int | None = None,
    salts: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Shuffle join whose hot left keys are spread over `salts` partitions.

    `how` is inner, left, left_semi or left_anti. `hot` may come from a cheaper
    table holding at least the rows of `left`. Only hot keys of `right` are
    repeated, and the salt is a hash of row values, so retried tasks agree.
    The hot keys are counted first; without any, this is a plain join. They are
    broadcast where their measured size allows. `partitions` fixes the number of
    partitions, for sides too large for the session's or for what follows in them.
    """
    if hot is None:
        hot = hot_keys(left, on, hot_rows)
    hot = hot.persist()  # counted once; lost parts are counted again from the source
    if hot.isEmpty():
        hot.unpersist()
        return dealt(left, on, partitions).join(dealt(right, on, partitions), on, how)
    if fits_broadcast(hot):
        hot = F.broadcast(hot)
    salts = setting(left.sparkSession, "salts", salts)
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    spread = (
        left.join(hot, on, "left")
        .withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0)))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    keys = [*on, "_salt"]
    return dealt(spread, keys, partitions).join(dealt(repeated, keys, partitions), keys, how).drop("_salt")


def dealt(df: DataFrame, by: list[str], partitions: int | None) -> DataFrame:
    return df if partitions is None else df.repartition(partitions, *by)


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str,
    salt_by: list[str],
    max_rows: int | None = None,
    max_bytes: int | None = None,
    hot_rows: int | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Join to a table derived from the taxonomy: broadcast when its measured
    size allows, salted shuffle join otherwise. `fits` skips the measuring."""
    if fits is None:
        fits = fits_broadcast(lookup, max_rows, max_bytes)
    if fits:
        return left.join(F.broadcast(lookup), on, how)
    return salted_join(left, lookup, on, how, salt_by, hot_rows=hot_rows)
