"""Listings stored by course: joins and windows on the course need no shuffle.

The table is bucketed by course. Courses with very many rows, and rows without a
course, are in a table beside it, which is not, so that no bucket is much larger
than the others. What is done per course is done on both and put together.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.operators.joins import fits_broadcast, hot_keys, lookup_join, partitions_for
from levelmark.sources.shared import scratch_path, written

COURSE = "course_ref"
#: Of a join: left, right, keys, kind, columns to salt by.
Join = Callable[[DataFrame, DataFrame, list[str], str, list[str]], DataFrame]


@dataclass
class ByCourse:
    """`rows` by course, `hot` spread; None where there are no hot courses."""

    rows: DataFrame
    hot: DataFrame | None

    def apply(self, work: Callable[[DataFrame, Join], DataFrame]) -> DataFrame:
        """`work` on both tables, with the join that suits each: it must look at one course at a time."""
        out = work(self.rows, _in_place)
        return out if self.hot is None else out.unionByName(work(self.hot, lookup_join))


def _in_place(left: DataFrame, right: DataFrame, on: list[str], how: str, salt_by: list[str]) -> DataFrame:
    """Both sides come from the buckets."""
    return left.join(right, on, how)


def store_by_course(listing: DataFrame, name: str, courses: DataFrame | None = None, buckets: int | None = None, hot_rows: int | None = None) -> None:
    """Stores a listing as the session's tables `name` and `name`_hot, below the
    shared folder: one scan for either table. There are so many buckets that one holds
    few rows, as a later query sorts each whole. Hot courses are counted on `courses`
    where that is a cheaper table of the same rows."""
    spark = listing.sparkSession
    known = listing if courses is None else courses
    buckets = buckets or partitions_for(spark, known.count())
    hot = written(hot_keys(known, [COURSE], hot_rows).where(F.col(COURSE).isNotNull()), "hot")
    apart = F.col(COURSE).isNull()
    marked = listing.withColumn("_apart", apart)
    if not hot.isEmpty():
        apart_ones = F.broadcast(hot) if fits_broadcast(hot) else hot
        marked = listing.join(apart_ones, COURSE, "left").withColumn("_apart", apart | F.coalesce("_hot", F.lit(False))).drop("_hot")
    rows = marked.where(~F.col("_apart")).drop("_apart").repartition(buckets, COURSE)
    rows.write.bucketBy(buckets, COURSE).sortBy(COURSE).option("path", scratch_path(spark, name)).saveAsTable(name)
    marked.where("_apart").drop("_apart").write.option("path", scratch_path(spark, name)).saveAsTable(f"{name}_hot")


def stored(spark: SparkSession, name: str) -> ByCourse | None:
    if not spark.catalog.tableExists(name):
        return None
    hot = spark.table(f"{name}_hot")
    return ByCourse(spark.table(name), None if hot.isEmpty() else hot)
