"""Data-quality rules over the given tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.operators import quality
from levelmark.reference_values import SECTORS
from levelmark.schemas import FRAMEWORK_COLUMNS, LISTING_COLUMNS
from levelmark.sources.scans import list_files
from levelmark.sources.shared import scratch_path
from levelmark.workload import rows
from levelmark.workload import tables as t
from levelmark.workload.registry import query


@query("""SELECT 'sector=other' AS folder, 'empty_file' AS rule
FROM part HAVING count(*) FILTER (WHERE p_brand = 'no such sector') = 0""")
def dq_empty_file(spark: SparkSession, folder: str) -> DataFrame:
    """A sector without rows leaves an empty file in its folder."""
    root = scratch_path(spark, "texts")
    titles = t.framework(spark, folder)
    for name, sector in (("chosen", t.SECTOR), ("other", "no such sector")):
        titles.where(F.col("sector") == sector).select("title").write.text(f"{root}/sector={name}")
    files = quality.empty_files(list_files(spark, root, "*.txt"))
    return files.select(F.regexp_extract("path", r"/(sector=\w+)/", 1).alias("folder"), "rule")


COLUMN_RULES_SQL = """
column_rules AS (
  SELECT 'framework' AS dataset, rule, c AS "column", (SELECT count(*) FROM part) AS n_bad
  FROM (VALUES ('missing_column', 'category'), ('missing_column', 'topic_code'), ('missing_column', 'topic_descr'),
               ('missing_column', 'topic_type'), ('extra_column', 'ord')) AS v(rule, c))
"""


@query(f"WITH {COLUMN_RULES_SQL} SELECT * FROM column_rules")
def dq_columns(spark: SparkSession, folder: str) -> DataFrame:
    report = quality.column_names(t.framework(spark, folder), "framework", list(FRAMEWORK_COLUMNS.values()))
    return report.select("dataset", "rule", "column", "n_bad")


RAW_LEVEL_SQL = """CASE WHEN p_size % 10 = 0 THEN 'unknown' WHEN p_size % 10 = 1 THEN NULL
  WHEN p_size % 10 = 2 THEN CAST(p_size AS VARCHAR) || '.5' ELSE CAST(p_size AS VARCHAR) END"""


def raw_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Framework whose level is text, as read from a file: words, blanks and
    fractions among whole numbers."""
    size = F.col("p_size")
    text = size.cast("string")
    raw = (
        F.when(size % 10 == 0, "unknown")
        .when(size % 10 == 1, F.lit(None).cast("string"))
        .when(size % 10 == 2, F.concat(text, F.lit(".5")))
        .otherwise(text)
    )
    parts = t.table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), raw.alias("raw"))
    return t.framework(spark, folder).drop("level").join(parts, "ord").withColumnRenamed("raw", "level")


LEVEL_RULES_SQL = f"""
raw AS (SELECT {RAW_LEVEL_SQL} AS level FROM part),
num AS (SELECT level, try_cast(level AS DOUBLE) AS v FROM raw),
level_rules AS (
  SELECT 'framework' AS dataset, 'not_numeric' AS rule, 'level' AS "column",
         count(*) FILTER (WHERE level IS NOT NULL AND v IS NULL) AS n_bad FROM num
  UNION ALL SELECT 'framework', 'not_whole', 'level', count(*) FILTER (WHERE v <> floor(v)) FROM num
  UNION ALL SELECT 'framework', 'empty_level', 'level', count(*) FILTER (WHERE level IS NULL) FROM num)
"""


@query(f'WITH {LEVEL_RULES_SQL} SELECT dataset, rule, "column", n_bad FROM level_rules WHERE n_bad > 0')
def dq_types(spark: SparkSession, folder: str) -> DataFrame:
    report = quality.level_types(raw_levels(spark, folder), "framework")
    return report.select("dataset", "rule", "column", "n_bad")


@query("""SELECT 'other sector' AS dataset, 'no_rows' AS rule, '*' AS "column", CAST(1 AS BIGINT) AS n_bad
FROM part HAVING count(*) FILTER (WHERE p_brand = 'no such sector') = 0""")
def dq_no_rows(spark: SparkSession, folder: str) -> DataFrame:
    fw = t.framework(spark, folder)
    empty = quality.no_rows(fw.where("sector = 'no such sector'"), "other sector")
    return quality.no_rows(fw, "framework").unionByName(empty).select("dataset", "rule", "column", "n_bad")


@query("SELECT 'listing' AS dataset, 'all_null' AS rule, 'course_title' AS \"column\", count(*) AS n_bad FROM lineitem")
def dq_all_null(spark: SparkSession, folder: str) -> DataFrame:
    listing = t.listing(spark, folder).withColumn("course_title", F.lit(None).cast("string"))
    report = quality.all_null(listing, "listing", ["course_ref", "course_title"])
    return report.select("dataset", "rule", "column", "n_bad")


@query(f"""WITH {rows.TITLE_FORMS_SQL}
SELECT skill_title, count(*) AS n_bad FROM li WHERE NOT ({rows.TITLE_OK_SQL}) GROUP BY skill_title""")
def dq_title_format(spark: SparkSession, folder: str) -> DataFrame:
    return quality.bad_titles(rows.title_forms(spark, folder))


def named_files(spark: SparkSession, folder: str, name: Column) -> DataFrame:
    """A file name per customer."""
    customers = t.table(spark, folder, "customer")
    return customers.select(F.col("c_custkey").alias("id"), F.concat(F.lit("inputs/"), name).alias("path"))


def nth(values: list[str], key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


SECTOR_LIST_SQL = "[" + ", ".join(f"'{name}'" for name in SECTORS.values()) + "]"
ALIAS_LIST_SQL = "[" + ", ".join(f"'{alias}'" for alias in SECTORS) + "]"


@query(f"""WITH f AS (SELECT c_custkey, {SECTOR_LIST_SQL}[CAST(c_custkey % 20 + 1 AS INTEGER)] AS name FROM customer)
SELECT 'inputs/' || CASE c_custkey % 4 WHEN 0 THEN 'Framework_' || name WHEN 1 THEN 'SFW_' WHEN 2 THEN 'SFW_' || name ELSE 'SFW_No ' || name END || '.csv' AS path,
       CASE c_custkey % 4 WHEN 0 THEN 'prefix' WHEN 1 THEN 'sector_missing' WHEN 2 THEN CASE WHEN name <> 'Human Resource' THEN 'other_sector' END ELSE 'sector_unknown' END AS rule,
       count(*) AS n_files
FROM f GROUP BY ALL""")
def dq_framework_name(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    sector = nth(list(SECTORS.values()), key)
    name = (
        F.when(key % 4 == 0, F.concat(F.lit("Framework_"), sector))
        .when(key % 4 == 1, "SFW_")
        .when(key % 4 == 2, F.concat(F.lit("SFW_"), sector))
        .otherwise(F.concat(F.lit("SFW_No "), sector))
    )
    files = named_files(spark, folder, F.concat(name, F.lit(".csv")))
    return quality.framework_names(files, alias="HR").groupBy("path", "rule").agg(F.count("*").alias("n_files"))


@query(f"""WITH f AS (
  SELECT c_custkey % 6 AS kind, {SECTOR_LIST_SQL}[CAST(c_custkey % 20 + 1 AS INTEGER)] AS name,
         {ALIAS_LIST_SQL}[CAST(c_custkey % 20 + 1 AS INTEGER)] AS alias FROM customer),
n AS (SELECT kind, CASE kind WHEN 0 THEN alias || '_' || name || '_sector_course_listing'
    WHEN 1 THEN alias || '_' || name WHEN 2 THEN alias || '_sector_course_listing'
    WHEN 3 THEN lower(alias) || '_' || name || '_sector_course_listing'
    WHEN 4 THEN 'X' || alias || '_' || name || '_sector_course_listing'
    ELSE alias || '_No ' || name || '_sector_course_listing' END AS stem FROM f)
SELECT 'inputs/' || stem || '.csv' AS path,
       CASE kind WHEN 1 THEN 'suffix' WHEN 2 THEN 'two_parts' WHEN 3 THEN 'alias_case' WHEN 4 THEN 'alias_unknown' WHEN 5 THEN 'name_mismatch' END AS rule,
       count(*) AS n_files
FROM n GROUP BY ALL""")
def dq_listing_name(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    sector = nth(list(SECTORS.values()), key)
    alias = nth(list(SECTORS), key)
    tail = F.lit("_sector_course_listing")
    kind = key % 6
    stem = (
        F.when(kind == 0, F.concat(alias, F.lit("_"), sector, tail))
        .when(kind == 1, F.concat(alias, F.lit("_"), sector))
        .when(kind == 2, F.concat(alias, tail))
        .when(kind == 3, F.concat(F.lower(alias), F.lit("_"), sector, tail))
        .when(kind == 4, F.concat(F.lit("X"), alias, F.lit("_"), sector, tail))
        .otherwise(F.concat(alias, F.lit("_No "), sector, tail))
    )
    files = named_files(spark, folder, F.concat(stem, F.lit(".csv")))
    return quality.listing_names(files).groupBy("path", "rule").agg(F.count("*").alias("n_files"))


@query(f"""WITH {LEVEL_RULES_SQL}, {COLUMN_RULES_SQL}, {rows.TITLE_FORMS_SQL}
SELECT dataset, rule, "column", n_bad FROM level_rules WHERE n_bad > 0
UNION ALL SELECT dataset, rule, "column", n_bad FROM column_rules
UNION ALL SELECT 'listing', 'not_text', 'course_ref', count(*) FROM li
UNION ALL SELECT 'listing', 'title_format', 'skill_title', count(*) FROM li WHERE NOT ({rows.TITLE_OK_SQL})
UNION ALL SELECT 'listing', 'list_cell', 'skill_title', count(*) FROM li WHERE l_linenumber % 6 IN (2, 4)""")
def dq_report(spark: SparkSession, folder: str) -> DataFrame:
    """All rules on both inputs."""
    fw = quality.framework_report(
        raw_levels(spark, folder), "framework", list(FRAMEWORK_COLUMNS.values()), ["sector", "title", "item"]
    )
    names = list(LISTING_COLUMNS.values())
    listing = quality.listing_report(rows.title_forms(spark, folder).select(*names), "listing", names, names)
    return fw.unionByName(listing).select("dataset", "rule", "column", "n_bad")


@query("""SELECT conv_id, count(*) AS n_runs, CASE WHEN count(*) > 1 THEN 'many' ELSE 'one' END AS status
FROM conversations GROUP BY conv_id""", name="dq_single_run")
def saved_states(spark: SparkSession, folder: str) -> DataFrame:
    """Saved states per conversation: more than one is an error."""
    states = t.table(spark, folder, "conversations")
    return quality.single_run(states, ["conv_id"])
