"""Listings stored by course, filters of ids."""

import random

from pyspark.sql import functions as F

from levelmark.operators.bloom import anti_join_filtered, bloom_filter, maybe_known
from levelmark.operators.joins import lookup_join
from levelmark.sources.by_course import store_by_course, stored
from levelmark.workload import tables as t
from levelmark.workload.joins import join_left_descr
from levelmark.workload.rows import coalesce_descr


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """Shuffles of a listing: all but that of the topics' keys."""
    return plan(df).count("Exchange hashpartitioning") - plan(df).count("Exchange hashpartitioning(skill_key")


def test_the_second_query_does_not_shuffle_the_listing(spark, folder):
    join_left_descr(spark, folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a large listing
    try:
        for query in (join_left_descr, coalesce_descr):
            df = query(spark, folder)
            assert shuffles(df) == 0 and "SortMergeJoin [course_ref" in plan(df)
            assert plan(df).count("levelmark_listing_") == plan(df).count("Bucketed: true") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known = t.stored_listing(spark, folder)
    assert known.hot is None and known.rows.count() == t.listing(spark, folder).count()


def test_hot_courses_lie_beside_the_buckets(spark):
    draw = random.Random(3)
    rows = [(draw.choice([1, 1, 1, 2, 3, 4, 5, None]), i, f"t{i}") for i in range(400)]
    listing = spark.createDataFrame(rows, "course_ref long, n long, title string")
    store_by_course(listing, "some_listing", hot_rows=100, buckets=3)
    found = stored(spark, "some_listing")
    assert {r["course_ref"] for r in found.hot.collect()} == {1, None} and found.rows.where("course_ref = 1").count() == 0

    def firsts(part, join):
        first = part.groupBy("course_ref").agg(F.min("n").alias("first"))
        return join(part, first, ["course_ref"], "left", ["n"])

    expected = firsts(listing, lookup_join)
    assert sorted(map(tuple, found.apply(firsts).collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    assert shuffles(firsts(found.rows, lambda a, b, on, how, _: a.join(b, on, how))) == 0
    store_by_course(listing.where("false"), "no_listing")
    assert stored(spark, "no_listing").apply(firsts).count() == 0
    assert stored(spark, "never_stored") is None


def test_filters_know_every_id_and_few_others(spark):
    known = spark.range(20_000).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("work_id")).unionByName(
        spark.createDataFrame([(None,)], "work_id string")
    )
    rows = spark.range(10_000, 60_000).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("work_id"), F.col("id").alias("n"))
    rows = rows.unionByName(spark.createDataFrame([(None, 7), (None, 8)], "work_id string, n long"))
    content = bloom_filter(known, "work_id", 1 << 18)
    assert len(content) == (1 << 18) // 8
    flags = rows.select("n", maybe_known(rows, "work_id", content).alias("maybe")).where("n >= 10000").collect()
    assert all(r["maybe"] for r in flags if r["n"] < 20_000)
    assert sum(r["maybe"] for r in flags if r["n"] >= 20_000) < 0.02 * 40_000
    for bits in (64, 1 << 18):  # a filter that is full tells nothing, and the result is the same
        left = anti_join_filtered(rows, known, "work_id", bits, flag="skipped").collect()
        assert sorted(r["n"] for r in left) == [7, 8, *range(20_000, 60_000)]
        assert (sum(r["skipped"] for r in left) > 39_000) == (bits > 64)
    nothing = anti_join_filtered(rows, known.where("false"), "work_id", 1 << 10)
    assert nothing.count() == rows.count()


def test_buckets_grow_with_the_listing(spark):
    """A later query sorts a bucket whole, so one holds few rows however long the listing is."""
    listing = spark.range(1000).select(F.col("id").alias("course_ref"), F.col("id").alias("n"))
    spark.conf.set("spark.levelmark.taskRows", 50)
    try:
        store_by_course(listing, "long_listing")
    finally:
        spark.conf.unset("spark.levelmark.taskRows")
    found = stored(spark, "long_listing").rows
    assert found.count() == 1000 and found.groupBy("course_ref").count().rdd.getNumPartitions() == 20
