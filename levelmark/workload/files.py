"""Scans, sinks and profiles over files written from the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelmark.plans.rounds import bucket_round1
from levelmark.reference_values import LEVEL_CHART, LEVEL_CHART_FIELDS, SECTORS, level_chart, sector_dimension
from levelmark.schemas import FRAMEWORK_COLUMNS, LISTING_COLUMNS, publish
from levelmark.sources import profiles, scans, sinks
from levelmark.sources.shared import scratch_path
from levelmark.workload import runs
from levelmark.workload import tables as t
from levelmark.workload.registry import query
from levelmark.workload.scoring import sql_text

STAMP = "20250101_0000"


def published_framework(spark: SparkSession, folder: str) -> DataFrame:
    """Framework under its published names and types."""
    fw = t.framework(spark, folder)
    rows = fw.select(
        F.lit("topic").alias("topic_type"),
        F.col("ord").cast("string").alias("topic_code"),
        "sector",
        F.lit("general").alias("category"),
        "title",
        F.lit(None).cast("string").alias("topic_descr"),
        "level",
        "level_descr",
        "item_class",
        "item",
    )
    return publish(rows, FRAMEWORK_COLUMNS)


def published_listing(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.long_listing(spark, folder).select(*LISTING_COLUMNS.values())
    return publish(rows.withColumn("course_ref", F.col("course_ref").cast("string")), LISTING_COLUMNS)


def input_folder(spark: SparkSession, folder: str) -> str:
    """One framework file set and one listing file set, told apart by name."""
    root = scratch_path(spark, "inputs")
    sinks.write_parquet(published_framework(spark, folder), f"{root}/SFW_Human Resource.parquet")
    sinks.write_parquet(published_listing(spark, folder), f"{root}/HR_Human Resource_sector_course_listing.parquet")
    return root


LISTED_SQL = f"""WITH {t.LONG_LISTING_SQL}
SELECT CAST(course_ref AS VARCHAR) AS course_ref, skill_title, course_title, learn, sha256(about) AS about FROM li"""


def listed(df: DataFrame) -> DataFrame:
    return df.select("course_ref", "skill_title", "course_title", "learn", F.sha2("about", 256).alias("about"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_projected(spark: SparkSession, folder: str) -> DataFrame:
    return scans.read_parquet(spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])


@query(f"""WITH {t.FRAMEWORK_SQL}
SELECT CAST(ord AS VARCHAR) AS topic_code, sector, title, level, level_descr, item_class, item FROM fw""")
def scan_framework(spark: SparkSession, folder: str) -> DataFrame:
    df = scans.read_framework(spark, input_folder(spark, folder))
    return df.select("topic_code", "sector", "title", "level", "level_descr", "item_class", "item")


@query(LISTED_SQL)
def scan_listing(spark: SparkSession, folder: str) -> DataFrame:
    return listed(scans.read_listing(spark, input_folder(spark, folder)))


@query(LISTED_SQL)
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "listing_csv")
    sinks.write_csv(published_listing(spark, folder), path)
    df = scans.read_csv(spark, path)
    return listed(df.toDF(*[LISTING_COLUMNS[c] for c in df.columns]))


def tagged_results(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Tagged rows as the three published buckets."""
    rows = runs.tagged_rows(spark, folder)
    bucket = (
        F.when(F.col("bucket") == "r1_valid", F.array(F.lit("all_tagged")))
        .when(F.col("bucket") == "r2_valid", F.array(F.lit("valid"), F.lit("all_tagged")))
        .when(F.col("bucket").isin("r2_invalid", "r2_untagged"), F.array(F.lit("invalid")))
    )
    return rows.withColumn("bucket", F.explode(bucket)).select(*columns, "bucket")


RESULTS_SQL = f"""
WITH {t.routed_sql()}, {runs.BUCKETS_SQL},
results AS (
  SELECT *, unnest(CASE bucket WHEN 'r1_valid' THEN ['all_tagged'] WHEN 'r2_valid' THEN ['valid', 'all_tagged']
                   ELSE ['invalid'] END) AS result
  FROM tagged WHERE bucket <> 'irrelevant')
"""


@query(f"{RESULTS_SQL} SELECT course_ref, skill_title, result AS bucket FROM results WHERE result = 'valid'")
def scan_results(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "results")
    sinks.write_results(tagged_results(spark, folder, ["course_ref", "skill_title"]), root, "B1")
    return scans.read_results(spark, root, "valid").select("course_ref", "skill_title", "bucket")


def yearly_files(spark: SparkSession, folder: str) -> str:
    """One small CSV file and one Parquet file per year of the orders."""
    root = scratch_path(spark, "years")
    orders = t.table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus")
    # Counted first: what is brought together per year is one row per status.
    counts = orders.groupBy("year", "o_orderstatus").agg(F.count("*").alias("n")).repartition("year")
    counts.write.partitionBy("year").option("header", True).csv(f"{root}/csv")
    counts.write.partitionBy("year").parquet(f"{root}/parquet")
    return root


YEAR_FOLDER = r"/(\w+/year=\d+)/"
YEARS_SQL = "years AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders)"


@query(f"""WITH {YEARS_SQL}
SELECT kind || '/year=' || CAST(y AS VARCHAR) AS folder, 1::BIGINT AS n_files, true AS filled
FROM years, (VALUES ('csv'), ('parquet')) AS k(kind)""")
def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    files = scans.list_files(spark, yearly_files(spark, folder), "part-*")
    return files.groupBy(F.regexp_extract("path", YEAR_FOLDER, 1).alias("folder")).agg(
        F.count("*").alias("n_files"), (F.min("length") > 0).alias("filled")
    )


@query(f"WITH {YEARS_SQL} SELECT 'csv/year=' || CAST(max(y) AS VARCHAR) AS folder FROM years")
def latest_file(spark: SparkSession, folder: str) -> DataFrame:
    files = scans.list_files(spark, yearly_files(spark, folder), "*.csv")
    return scans.latest_file(files).select(F.regexp_extract("path", YEAR_FOLDER, 1).alias("folder"))


@query(f"""WITH {YEARS_SQL}
SELECT 'csv/year=' || CAST(y AS VARCHAR) AS folder, true AS size_ok, false AS empty_ok FROM years""")
def size_ok(spark: SparkSession, folder: str) -> DataFrame:
    """Every file passes the default limit and none passes a limit of 0."""
    files = scans.size_check(scans.list_files(spark, yearly_files(spark, folder), "*.csv"))
    none = scans.size_check(files.withColumnRenamed("size_ok", "ok"), max_mb=0)
    return none.select(
        F.regexp_extract("path", YEAR_FOLDER, 1).alias("folder"), F.col("ok").alias("size_ok"), F.col("size_ok").alias("empty_ok")
    )


@query(f"""WITH {YEARS_SQL}
SELECT suffix, count(*) AS n_files, count(*) FILTER (WHERE suffix = 'csv') AS n_convertible
FROM years, (VALUES ('csv'), ('parquet')) AS k(suffix) GROUP BY suffix""")
def conversion_summary(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.extension_counts(scans.list_files(spark, yearly_files(spark, folder), "part-*"))


SECTORS_SQL = "sectors(position, alias, full_name) AS (VALUES %s)" % ", ".join(
    f"({i}, '{alias}', '{name}')" for i, (alias, name) in enumerate(SECTORS.items(), 1)
)


@query(f"""WITH {SECTORS_SQL}
SELECT alias, full_name, alias || ' (' || full_name || ')' AS label, count(p_partkey) AS n_rows
FROM sectors LEFT JOIN part ON p_brand = 'Brand#' || CAST(position AS VARCHAR) GROUP BY ALL""")
def dim_sector(spark: SparkSession, folder: str) -> DataFrame:
    """Framework rows per sector of the picker; the n-th sector is brand n."""
    counts = t.framework(spark, folder).groupBy("sector").agg(F.count("*").alias("n"))
    # Fixed 20-row dimension on the left; counts are pre-aggregated.
    dim = sector_dimension(spark).withColumn("sector", F.concat(F.lit("Brand#"), F.col("position").cast("string")))
    joined = dim.join(counts, "sector", "left")
    return joined.select("alias", "full_name", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"))


CHART_SQL = "chart(level, text) AS (VALUES %s)" % ", ".join(
    f"({row[0]}, {sql_text(' '.join(line for field in row[1:] for line in field))})" for row in LEVEL_CHART
)


@query(f"""WITH {t.FRAMEWORK_SQL}, {CHART_SQL}
SELECT c.level, c.text, count(*) AS n_rows FROM fw JOIN chart c ON fw.level = c.level GROUP BY c.level, c.text""")
def dim_level_chart(spark: SparkSession, folder: str) -> DataFrame:
    """Framework rows per level of the generic chart, with the chart's text."""
    text = F.array_join(F.concat(*LEVEL_CHART_FIELDS), " ").alias("text")
    chart = level_chart(spark).select("level", text)
    counts = t.framework(spark, folder).groupBy("level").agg(F.count("*").alias("n_rows"))
    return counts.join(F.broadcast(chart), "level").select("level", "text", "n_rows")


@query(f"WITH {t.LISTING_SQL} SELECT course_ref, skill_title, about, learn, l_quantity FROM li")
def sink_parquet(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "plain")
    sinks.write_parquet(t.listing(spark, folder), path, compression="zstd")
    return scans.read_parquet(spark, path, ["course_ref", "skill_title", "about", "learn", "l_quantity"])


@query(f"""SELECT 'framework' AS role, '{STAMP}' AS run_ts, count(*) AS n_rows FROM part
UNION ALL SELECT 'listing', '{STAMP}', count(*) FROM lineitem""")
def sink_inputs(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "stored")
    sinks.write_inputs(published_framework(spark, folder), published_listing(spark, folder), root, STAMP)
    counts = [
        scans.read_role(spark, root, role)
        .groupBy(F.lit(role).alias("role"), F.col("run_ts").cast("string").alias("run_ts"))
        .agg(F.count("*").alias("n_rows"))
        for role in ("framework", "listing")
    ]
    return counts[0].unionByName(counts[1])


RESULT_COUNTS_SQL = "SELECT result AS bucket, count(*) AS n_rows, count(DISTINCT course_ref) AS n_courses FROM results GROUP BY result"


@query(f"{RESULTS_SQL} {RESULT_COUNTS_SQL}")
def sink_results(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "results")
    sinks.write_results(tagged_results(spark, folder, ["course_ref"]), root, "B1")
    return (
        scans.read_results(spark, root)
        .groupBy("bucket")
        .agg(F.count("*").alias("n_rows"), F.count_distinct("course_ref").alias("n_courses"))
    )


@query(f"""WITH {t.routed_sql()}
SELECT 'B1' AS sector, CASE WHEN relevance <> 'In Sector' THEN 'irrelevant' WHEN p.level IS NULL THEN 'r1_invalid' ELSE 'r1_valid' END AS bucket,
       course_ref, skill_title, answer1 AS level
FROM routed r LEFT JOIN pairs p ON r.skill_key = p.skill_key AND r.answer1 = p.level""")
def sink_routed(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "routed")
    topics = t.topics(spark, folder)
    rows = t.routed(spark, folder).withColumn("level", F.col("answer1"))
    bucketed = bucket_round1(rows, topics, F.lit(False))
    sinks.write_results(bucketed.select("bucket", "course_ref", "skill_title", "level"), root, "B1")
    return scans.read_results(spark, root)


@query(f"{RESULTS_SQL} SELECT course_ref, skill_title, result AS bucket FROM results")
def sink_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "export")
    sinks.write_csv(tagged_results(spark, folder, ["course_ref", "skill_title"]), path)
    return scans.read_csv(spark, path, "course_ref bigint, skill_title string, bucket string")


@query(LISTED_SQL)
def convert_csv(spark: SparkSession, folder: str) -> DataFrame:
    source = scratch_path(spark, "source_csv")
    published = published_listing(spark, folder)
    # Texts shrink to a sixth; a file, which is one split then, holds a million rows at most.
    sinks.write_csv(published, source, compression="gzip")
    table = sinks.convert_csv(spark, source, published.schema, scratch_path(spark, "converted"))
    return listed(table.select(*[F.col(f"`{name}`").alias(short) for name, short in LISTING_COLUMNS.items()]))


@query("""SELECT 'part=' || CAST(p_size % 4 AS VARCHAR) AS source,
       count(*) FILTER (WHERE p_size % 7 <> 0) AS n_good, count(*) FILTER (WHERE p_size % 7 = 0) AS n_bad
FROM part GROUP BY ALL""")
def convert_dir(spark: SparkSession, folder: str) -> DataFrame:
    """Several CSV folders converted in one job; lines with a number that is
    none are kept as malformed and do not stop it."""
    source = scratch_path(spark, "workspace")
    size = F.col("p_size")
    rows = t.table(spark, folder, "part").select(
        "p_name",
        F.when(size % 7 == 0, "unknown").otherwise(size.cast("string")).alias("p_size"),
        (size % 4).alias("part"),
    )
    rows.write.partitionBy("part").option("header", True).csv(source)
    schema = T.StructType([T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType())])
    table = sinks.convert_csv(spark, f"{source}/part=*", schema, scratch_path(spark, "converted"))
    return sinks.conversion_report(table, F.regexp_extract("src_file", r"/(part=\d+)/", 1))


@query(f"""{RESULTS_SQL}
SELECT CASE result WHEN 'valid' THEN 'Valid Skills for B1 sector' WHEN 'invalid' THEN 'Invalid Skills for B1'
            ELSE 'All Tagged Skills for B1 sector' END AS result_name, count(*) AS n_rows
FROM results GROUP BY ALL""")
def name_results(spark: SparkSession, folder: str) -> DataFrame:
    rows = tagged_results(spark, folder, ["course_ref"])
    return rows.groupBy(sinks.result_name(F.col("bucket"), "B1").alias("result_name")).agg(F.count("*").alias("n_rows"))


@query("""SELECT 4::BIGINT AS n_files, true AS filled, 4::BIGINT AS n_row_groups, count(*) AS n_rows, CAST(11 AS INTEGER) AS n_columns,
  'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS column_names
FROM lineitem""")
def profile_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """A table stored in four files; SQL cannot know its bytes, only that there are some."""
    path = scratch_path(spark, "lines")
    t.table(spark, folder, "lineitem").repartition(4).write.parquet(path)
    profile = profiles.parquet_profile(spark, path)
    return profile.withColumn("filled", F.col("bytes") > F.col("n_rows")).drop("bytes")


@query("""SELECT 'l_orderkey' AS column_name, count(*) AS n_rows, 0::BIGINT AS n_nulls, 'zstd' AS codecs,
       CAST(min(l_orderkey) AS VARCHAR) AS low, CAST(max(l_orderkey) AS VARCHAR) AS high FROM lineitem
UNION ALL SELECT 'l_returnflag', count(*), count(*) FILTER (WHERE l_returnflag = 'A'), 'zstd',
       min(nullif(l_returnflag, 'A')), max(nullif(l_returnflag, 'A')) FROM lineitem
UNION ALL SELECT 'l_shipdate', count(*), 0, 'zstd', CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR), CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) FROM lineitem""")
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    """What the footers of a table say about its columns."""
    flag = F.col("l_returnflag")
    rows = t.table(spark, folder, "lineitem").select("l_orderkey", F.when(flag != "A", flag).alias("l_returnflag"), F.to_date("l_shipdate").alias("l_shipdate"))
    path = scratch_path(spark, "lines")
    sinks.write_parquet(rows, path, compression="zstd")
    return profiles.column_profile(spark, path).drop("bytes")


FRAMEWORK_KINDS = {
    "ord": "bigint",
    "sector": "string",
    "title": "string",
    "level": "int",
    "level_descr": "string",
    "item_class": "string",
    "item": "string",
}


@query(
    f"WITH {t.FRAMEWORK_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS kind, count(*) AS n_rows, count({c}) AS n_filled FROM fw"
        for c, kind in FRAMEWORK_KINDS.items()
    )
)
def profile_frame(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.frame_profile(t.framework(spark, folder))


@query(f"{RESULTS_SQL} SELECT count(DISTINCT result) AS n_results, count(DISTINCT result) = 3 AS complete FROM results")
def run_complete(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.run_complete(tagged_results(spark, folder, ["course_ref"]))
