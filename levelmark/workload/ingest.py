"""Checking and storing an upload built from the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.plans.ingest import Upload, ingest, ingest_folder, input_report, verdict
from levelmark.schemas import LISTING_COLUMNS, publish
from levelmark.sources import sinks
from levelmark.sources.scans import read_role
from levelmark.sources.shared import scratch_path
from levelmark.workload import checks, files, rows, runs
from levelmark.workload import tables as t
from levelmark.workload.registry import query

STAMP = "20240102_0304"
MB = 1024 * 1024


def uploaded_files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """A file per customer: names in turn, lengths of 0 to 240 MB."""
    key = F.col("id")
    named = checks.named_files(spark, folder, checks.nth(names, F.col("c_custkey")))
    return named.select("path", (key % 5 * 60 * MB).cast("bigint").alias("length"))


FRAMEWORK_FILES = ["Framework_Human Resource.csv", "SFW_.csv", "SFW_Human Resource.csv", "SFW_No Human Resource.csv"]
LISTING_FILES = [
    "HR_Human Resource_sector_course_listing.csv",
    "HR_Human Resource.csv",
    "hr_Human Resource_sector_course_listing.csv",
]


def faulty_upload(spark: SparkSession, folder: str) -> Upload:
    return Upload(
        framework=checks.raw_levels(spark, folder),
        listing=rows.title_forms(spark, folder).select(*LISTING_COLUMNS.values(), *t.ORDER),
        framework_files=uploaded_files(spark, folder, FRAMEWORK_FILES),
        listing_files=uploaded_files(spark, folder, LISTING_FILES),
        alias="HR",
        order=t.ORDER,
        framework_order=t.FRAMEWORK_ORDER,
    )


REPORT_SQL = f"""
WITH {checks.LEVEL_RULES_SQL}, {checks.COLUMN_RULES_SQL}, {rows.TITLE_FORMS_SQL},
file_rules AS (
  SELECT d AS dataset, CASE WHEN c_custkey % 5 = 0 THEN 'empty_file' WHEN c_custkey % 5 >= 2 THEN 'too_large' END AS rule
  FROM customer, (VALUES ('framework'), ('listing')) AS v(d)
  UNION ALL SELECT 'framework', ['prefix', 'sector_missing', NULL, 'sector_unknown'][CAST(c_custkey % 4 + 1 AS INTEGER)] FROM customer
  UNION ALL SELECT 'listing', [NULL, 'suffix', 'alias_case'][CAST(c_custkey % 3 + 1 AS INTEGER)] FROM customer),
report AS (
  SELECT dataset, rule, "column", n_bad FROM level_rules WHERE n_bad > 0
  UNION ALL SELECT dataset, rule, "column", n_bad FROM column_rules WHERE rule = 'missing_column'
  UNION ALL SELECT 'listing', 'not_text', 'course_ref', count(*) FROM li
  UNION ALL SELECT 'listing', 'title_format', 'skill_title', count(*) FROM li WHERE NOT ({rows.TITLE_OK_SQL})
  UNION ALL SELECT 'listing', 'list_cell', 'skill_title', count(*) FROM li WHERE l_linenumber % 6 IN (2, 4)
  UNION ALL SELECT dataset, rule, '*', count(*) FROM file_rules WHERE rule IS NOT NULL GROUP BY dataset, rule)
"""


@query(f"""{REPORT_SQL} SELECT *, CASE rule
  WHEN 'not_numeric' THEN 'should be a number' WHEN 'not_whole' THEN 'should be a whole number'
  WHEN 'empty_level' THEN 'should not be empty' WHEN 'missing_column' THEN 'column is missing'
  WHEN 'not_text' THEN 'should be text, is bigint' WHEN 'title_format' THEN 'neither a name nor a list'
  WHEN 'list_cell' THEN 'starts like a list but cannot be read as one' WHEN 'empty_file' THEN 'the file is empty'
  WHEN 'too_large' THEN 'the file is too large' WHEN 'prefix' THEN 'the name should start with the framework prefix'
  WHEN 'sector_missing' THEN 'the name lacks the sector' WHEN 'sector_unknown' THEN 'the sector is not known'
  WHEN 'suffix' THEN 'the name should end with the listing suffix' WHEN 'alias_case' THEN 'the alias should be in capitals'
  END AS message FROM report""")
def ingest_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every failed rule of an upload's files and tables."""
    return input_report(faulty_upload(spark, folder))


@query(f"""{REPORT_SQL} SELECT count(*) FILTER (WHERE rule <> 'list_cell') AS n_failed,
  count(*) FILTER (WHERE rule = 'list_cell') AS n_set_aside, bool_and(rule = 'list_cell') AS passed FROM report""")
def ingest_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return verdict(input_report(faulty_upload(spark, folder)))


@query(f"""WITH {runs.LIST_CELLS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY course_ref, skill_title ORDER BY {t.ORDER_SQL}) AS rn FROM li WHERE about IS NOT NULL),
clean AS (SELECT * FROM ranked WHERE rn = 1), {t.first_descriptions_sql("clean")},
skills AS (
  SELECT course_ref, l_linenumber, skill_key AS skill_title FROM clean WHERE l_linenumber % 4 IN (0, 1)
  UNION ALL SELECT course_ref, l_linenumber, 'extra ' || skill_key FROM clean WHERE l_linenumber % 4 = 0)
SELECT CAST(s.course_ref AS VARCHAR) AS course_ref, l_linenumber, skill_title, d.course_title, d.about, d.learn
FROM skills s LEFT JOIN descr d ON s.course_ref = d.course_ref
UNION ALL SELECT CAST(course_ref AS VARCHAR), l_linenumber, skill_title, course_title, about, learn FROM clean WHERE l_linenumber % 4 = 3""")
def ingest_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The stored listing of an upload whose titles come in both formats."""
    listing = runs.list_cells(spark, folder).withColumn("course_ref", F.col("course_ref").cast("string"))
    sector = t.table(spark, folder, "region").agg(F.lit(MB).cast("bigint").alias("length"))
    upload = Upload(
        framework=files.published_framework(spark, folder),
        listing=listing.select(*LISTING_COLUMNS.values(), *t.ORDER),
        framework_files=sector.withColumn("path", F.lit("inputs/SFW_Human Resource.csv")),
        listing_files=sector.withColumn("path", F.lit("inputs/HR_Human Resource_sector_course_listing.csv")),
        alias="HR",
        order=t.ORDER,
        required=["about"],
    )
    root = scratch_path(spark, "upload")
    if not ingest(upload, root, STAMP):
        raise ValueError("the upload does not pass")
    stored = read_role(spark, root, "listing")
    return stored.select("course_ref", "l_linenumber", "skill_title", "course_title", "about", "learn")


@query("SELECT DISTINCT strftime(o_orderdate, '%Y%m%d_%H%M') AS stamp FROM orders")
def ingest_stamp(spark: SparkSession, folder: str) -> DataFrame:
    """The stamps of uploads that came on the days of the orders."""
    orders = t.table(spark, folder, "orders")
    return orders.select(sinks.run_stamp(F.col("o_orderdate")).alias("stamp")).distinct()


FOLDER_SQL = f"""
WITH {t.FRAMEWORK_SQL}, {runs.LIST_CELLS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY course_ref, skill_title ORDER BY {t.ORDER_SQL}) AS rn FROM li WHERE about IS NOT NULL),
clean AS (SELECT * FROM ranked WHERE rn = 1),
skills AS (
  SELECT course_ref, skill_key AS skill_title FROM clean WHERE l_linenumber % 4 IN (0, 1)
  UNION ALL SELECT course_ref, 'extra ' || skill_key FROM clean WHERE l_linenumber % 4 = 0
  UNION ALL SELECT course_ref, skill_title FROM clean WHERE l_linenumber % 4 = 3)
"""


@query(f"""{FOLDER_SQL}
SELECT 'listing' AS role, count(*) AS n_rows, count(DISTINCT course_ref) AS n_keys, count(DISTINCT skill_title) AS n_values FROM skills
UNION ALL SELECT 'framework', count(*), count(DISTINCT title), count(DISTINCT level) FROM fw""", name="ingest_folder")
def folder_upload(spark: SparkSession, folder: str) -> DataFrame:
    """A folder with a framework and a listing as CSV files, whose cells hold quotes
    and line breaks, checked, cleaned and stored."""
    source, root = scratch_path(spark, "uploads"), scratch_path(spark, "upload")
    listing = runs.list_cells(spark, folder).withColumn("learn", F.regexp_replace("learn", "^Line ", 'Line\n"'))
    listing = listing.withColumn("course_ref", F.col("course_ref").cast("string")).select(*LISTING_COLUMNS.values())
    sinks.write_csv(files.published_framework(spark, folder), f"{source}/SFW_Human Resource.csv")
    sinks.write_csv(publish(listing, LISTING_COLUMNS), f"{source}/HR_Human Resource_sector_course_listing.csv")
    passed, _ = ingest_folder(spark, source, "HR", root, STAMP, required=["about"])
    if not passed:
        raise ValueError("the upload does not pass")

    def counted(role: str, key: str, value: str) -> DataFrame:
        n = F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count_distinct(value).alias("n_values")
        return read_role(spark, root, role).agg(F.lit(role).alias("role"), *n)

    return counted("listing", "course_ref", "skill_title").unionByName(counted("framework", "title", "level"))
