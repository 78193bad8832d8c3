"""Framework, listing and answers derived from the given tables, in Spark and
as SQL fragments.

`part` plays the framework (title `p_name`, sector `p_brand`, level from
`p_size`), `lineitem` joined to `part` the listing, `documents` the long course
texts, and arithmetic on prices and quantities the fixed answers.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.operators.joins import hot_keys, partitions_for, salted_join, setting
from levelmark.operators.listing import dedupe_then_drop, with_skill_key
from levelmark.operators.routing import flag_relevance
from levelmark.operators.taxonomy import sector_framework
from levelmark.sources.by_course import ByCourse, store_by_course, stored

SECTOR = "Brand#1"
# Total order of the rows of one course.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
ROW_KEY = ["course_ref", *ORDER]
FRAMEWORK_ORDER = ["ord"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def framework(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("ord"),
        F.col("p_brand").alias("sector"),
        F.col("p_name").alias("title"),
        (size % 6 + 1).alias("level"),
        F.concat("p_type", F.lit(" grade "), size.cast("string")).alias("level_descr"),
        F.when(size % 2 == 0, "knowledge").otherwise("ability").alias("item_class"),
        F.when(size % 7 != 0, F.col("p_type")).alias("item"),
    )


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen sector's part of the framework."""
    return sector_framework(framework(spark, folder), [SECTOR])


def listing(spark: SparkSession, folder: str) -> DataFrame:
    # A scan joined to a scan: AQE broadcasts a small part table and splits the
    # partitions of a hot part key of a large one.
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.expr("l_partkey = p_partkey"))
    kind = F.col("l_linenumber") % 3
    name = F.col("p_name")
    return rows.select(
        F.col("l_orderkey").alias("course_ref"),
        F.when(kind == 0, F.upper(name)).when(kind == 1, F.concat(F.lit("  "), name)).otherwise(name).alias("skill_title"),
        F.concat(F.lit("Course "), F.col("l_orderkey").cast("string")).alias("course_title"),
        F.when(F.col("p_size") % 11 != 0, F.col("p_type")).alias("about"),
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("learn"),
        *ORDER,
        (F.col("l_quantity").cast("int") % 7).alias("answer1"),
        (F.floor("l_extendedprice") % 7).cast("int").alias("answer2"),
    )


def task_count(spark: SparkSession, folder: str) -> int:
    """As many tasks as keep the listing rows of one few; counted in the files' footers."""
    return partitions_for(spark, table(spark, folder, "lineitem").count())


def with_documents(
    rows: DataFrame, spark: SparkSession, folder: str, hot: DataFrame | None = None, partitions: int | None = None
) -> DataFrame:
    """Puts a whole document into `about` where the course has one."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("course_ref"), F.col("text").alias("_text"))
    salt_by = [c for c in ("l_linenumber", "l_partkey", "skill_key") if c in rows.columns]
    hot = hot_courses(spark, folder) if hot is None else hot
    joined = salted_join(rows, docs, ["course_ref"], "left", salt_by, hot=hot, partitions=partitions)
    return joined.withColumn("about", F.coalesce("_text", "about")).drop("_text")


def long_listing(spark: SparkSession, folder: str) -> DataFrame:
    return with_documents(listing(spark, folder), spark, folder)


def keyed(spark: SparkSession, folder: str) -> DataFrame:
    return with_skill_key(listing(spark, folder))


def clean(spark: SparkSession, folder: str, title: str = "skill_title", rows: DataFrame | None = None) -> DataFrame:
    """First row per course and title, then rows that have a description."""
    rows = listing(spark, folder) if rows is None else rows
    return dedupe_then_drop(with_skill_key(rows), ["about"], ORDER, title)


def routed(
    spark: SparkSession, folder: str, title: str = "skill_title", fits: bool | None = None, rows: DataFrame | None = None
) -> DataFrame:
    return flag_relevance(clean(spark, folder, title, rows), topics(spark, folder), salt_by=["course_ref", title], fits=fits)


def hot_courses(spark: SparkSession, folder: str) -> DataFrame:
    """Courses with very many rows, counted on the bare scan."""
    return hot_keys(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("course_ref")), ["course_ref"])


def stored_listing(spark: SparkSession, folder: str) -> ByCourse:
    """The listing by course, stored by the first query of a session that needs it;
    anew when the files of its tables have changed or other courses count as hot."""
    facts = ["_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"]
    files = table(spark, folder, "lineitem").select(*facts).unionByName(table(spark, folder, "part").select(*facts)).distinct()
    marks = files.agg(F.sort_array(F.collect_list(F.concat_ws("|", *(F.col(c).cast("string") for c in files.columns)))).alias("m"))
    limits = [setting(spark, n) for n in ("hotRows", "broadcastRows", "broadcastBytes")]
    # Named by the application too: another one's files may be gone.
    app = "".join(c for c in spark.sparkContext.applicationId if c.isalnum())
    name = f"levelmark_listing_{app}_{marks.select(F.sha2(F.concat_ws(',', F.array_join('m', ','), F.lit(str(limits))), 256)).first()[0][:24]}"
    found = stored(spark, name)
    if found is None:
        courses = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("course_ref"))
        store_by_course(listing(spark, folder), name, courses)
        found = stored(spark, name)
    return found


# SQL fragments (each starts a WITH clause).
FRAMEWORK_SQL = f"""
fw AS (
  SELECT p_partkey AS ord, p_brand AS sector, p_name AS title, lower(trim(p_name)) AS skill_key,
         CAST(p_size % 6 + 1 AS INTEGER) AS level,
         p_type || ' grade ' || CAST(p_size AS VARCHAR) AS level_descr,
         CASE WHEN p_size % 2 = 0 THEN 'knowledge' ELSE 'ability' END AS item_class,
         CASE WHEN p_size % 7 <> 0 THEN p_type END AS item
  FROM part),
topics AS (SELECT * FROM fw WHERE sector = '{SECTOR}'),
topic_keys AS (SELECT DISTINCT skill_key FROM topics),
pairs AS (SELECT DISTINCT skill_key, level FROM topics)
"""

LISTING_SQL = """
li0 AS (
  SELECT l_orderkey AS course_ref,
         CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name ELSE p_name END AS skill_title,
         lower(trim(p_name)) AS skill_key,
         'Course ' || CAST(l_orderkey AS VARCHAR) AS course_title,
         CASE WHEN p_size % 11 <> 0 THEN p_type END AS about,
         'Line ' || CAST(l_linenumber AS VARCHAR) AS learn,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate,
         CAST(CAST(l_quantity AS INTEGER) % 7 AS INTEGER) AS answer1,
         CAST(CAST(floor(l_extendedprice) AS BIGINT) % 7 AS INTEGER) AS answer2
  FROM lineitem JOIN part ON l_partkey = p_partkey),
li AS (SELECT * FROM li0)
"""

LONG_LISTING_SQL = LISTING_SQL.replace(
    "li AS (SELECT * FROM li0)",
    "li AS (SELECT li0.* REPLACE (coalesce(text, about) AS about) "
    "FROM li0 LEFT JOIN documents ON doc_id = course_ref)",
)

ORDER_SQL = ", ".join(ORDER)


def clean_sql(title: str = "skill_title") -> str:
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY course_ref, {title} ORDER BY {ORDER_SQL}) AS rn FROM li),
clean AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1 AND about IS NOT NULL)
"""


def routed_sql(title: str = "skill_title") -> str:
    return f"""
{FRAMEWORK_SQL}, {LISTING_SQL}, {clean_sql(title)},
routed AS (
  SELECT c.*, CASE WHEN k.skill_key IS NULL THEN 'Not in sector' ELSE 'In Sector' END AS relevance
  FROM clean c LEFT JOIN topic_keys k ON c.skill_key = k.skill_key),
work AS (SELECT * FROM routed WHERE relevance = 'In Sector')
"""


def first_descriptions_sql(source: str = "li") -> str:
    return f"""
descr AS (
  SELECT course_ref, course_title, about, learn FROM (
    SELECT *, row_number() OVER (PARTITION BY course_ref ORDER BY {ORDER_SQL}) AS dn FROM {source}) WHERE dn = 1)
"""
