"""From uploaded files to stored inputs: list, read, check, decide, clean, store."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelmark.functions.text import parse_list_cell
from levelmark.operators.listing import (
    drop_then_dedupe,
    extract_list_skills,
    order_only,
    rename_if_present,
    trim_headers,
)
from levelmark.operators.quality import FRAMEWORK_PREFIX, framework_names, framework_report, listing_names, listing_report
from levelmark.plans.rounds import REQUIRED
from levelmark.schemas import FILE_ORDER, FRAMEWORK_COLUMNS, LISTING_COLUMNS, shorten
from levelmark.sources.csv_records import csv_header, csv_records, csv_rows
from levelmark.sources.scans import list_files, size_check, with_file_order
from levelmark.sources.sinks import run_stamp, write_inputs, write_parquet

FILE_MESSAGES = {
    "empty_file": "the file is empty",
    "too_large": "the file is too large",
    "prefix": "the name should start with the framework prefix",
    "suffix": "the name should end with the listing suffix",
    "two_parts": "the name should hold an alias and a sector",
    "alias_missing": "the name lacks the alias",
    "alias_case": "the alias should be in capitals",
    "alias_unknown": "the alias is not known",
    "sector_missing": "the name lacks the sector",
    "sector_unknown": "the sector is not known",
    "other_sector": "the name is of another sector",
    "name_mismatch": "alias and sector do not belong together",
    "format": "the format is not known",
    "missing_file": "there is no such file",
}
#: Found but not fatal: the rows are set aside.
SET_ASIDE = ["list_cell"]


@dataclass
class Upload:
    """Files (path, length) and their tables under published headers. The
    order columns, which give the position of a row, are not checked."""

    framework: DataFrame
    listing: DataFrame
    framework_files: DataFrame
    listing_files: DataFrame
    alias: str
    order: list[str]
    framework_order: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=lambda: list(REQUIRED))
    max_mb: int = 100

    def __post_init__(self) -> None:
        self.framework = shorten(trim_headers(self.framework), FRAMEWORK_COLUMNS)
        self.listing = shorten(rename_if_present(trim_headers(self.listing)), LISTING_COLUMNS)


def file_report(files: DataFrame, named: DataFrame, dataset: str, max_mb: int) -> DataFrame:
    """Files per failing rule: length, size, name (`named` as path, rule)."""
    sized = size_check(files, max_mb)
    rule = F.when(F.col("length") == 0, "empty_file").when(~F.col("size_ok"), "too_large")
    bad = sized.select(rule.alias("rule")).unionByName(named.select("rule")).where("rule IS NOT NULL")
    message = F.create_map(*[F.lit(x) for pair in FILE_MESSAGES.items() for x in pair])[F.col("rule")]
    counts = bad.groupBy("rule").agg(F.count("*").alias("n_bad"))
    return counts.select(F.lit(dataset).alias("dataset"), "rule", F.lit("*").alias("column"), "n_bad", message.alias("message"))


def input_report(upload: Upload) -> DataFrame:
    """Every failed rule of both files and both tables with its message."""
    framework = upload.framework.drop(*upload.framework_order)
    listing = upload.listing.drop(*order_only(upload.order))
    texts = [c for c in FRAMEWORK_COLUMNS.values() if c != "level"]
    names = list(LISTING_COLUMNS.values())
    parts = [
        file_report(upload.framework_files, framework_names(upload.framework_files, upload.alias), "framework", upload.max_mb),
        file_report(upload.listing_files, listing_names(upload.listing_files), "listing", upload.max_mb),
        framework_report(framework, "framework", list(FRAMEWORK_COLUMNS.values()), texts),
        listing_report(listing, "listing", names, names),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def verdict(report: DataFrame) -> DataFrame:
    """One row: failed rules, those whose rows are only set aside, and whether the upload passes."""
    fatal = F.count_if(~F.col("rule").isin(SET_ASIDE))
    return report.agg(fatal.alias("n_failed"), F.count_if(F.col("rule").isin(SET_ASIDE)).alias("n_set_aside"), (fatal == 0).alias("passed"))


def unreadable_cells(listing: DataFrame) -> DataFrame:
    """Rows whose title starts like a list and cannot be read as one."""
    title = F.col("skill_title")
    return listing.where(F.coalesce(title.startswith("[") & parse_list_cell(title).isNull(), F.lit(False)))


def whole_levels(framework: DataFrame) -> DataFrame:
    """Levels that came as text, as numbers: a passing upload has whole ones only."""
    if not isinstance(framework.schema["level"].dataType, T.StringType):
        return framework
    return framework.withColumn("level", F.col("level").try_cast("double").cast("int"))


def ingest(upload: Upload, root: str, stamp: str) -> bool:
    """Checks an upload and, where it passes, stores both inputs under `root`
    by role and run stamp. Where any title is a list, lists in either quotes are
    taken apart; plain rows stay. Unreadable cells go to `rejected`, the
    report to `report`, also for an upload that fails."""
    spark = upload.listing.sparkSession
    path = f"{root}/report/run_ts={stamp}"
    write_parquet(input_report(upload), path)
    passed = verdict(spark.read.parquet(path)).first()["passed"]
    if passed:
        write_parquet(unreadable_cells(upload.listing), f"{root}/rejected/run_ts={stamp}")
        clean = drop_then_dedupe(upload.listing, upload.required, upload.order)
        if not upload.listing.where(F.col("skill_title").startswith("[")).isEmpty():
            clean = extract_list_skills(clean, upload.order, keep_plain=True)
        write_inputs(whole_levels(upload.framework), clean, root, stamp)
    return passed


# From a folder

FORMATS = ("csv", "parquet")
CSV_ORDER = ["src_file", "start", "number"]


def file_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, role, format) of what lies in a folder: a file, or a folder
    of part files that goes by one name. The framework's names start with its prefix.
    The length is that of the largest file, as the limit is one of each file."""
    folder = folder.rstrip("/")
    files = list_files(spark, folder)
    place = F.regexp_replace(F.lit(folder), "^file:/+", "/")
    name = F.regexp_extract(F.substr("path", F.instr("path", place) + F.length(place) + 1), "^[^/]*", 0)
    sets = files.groupBy(name.alias("name")).agg(F.max("length").alias("length"))
    role = F.when(F.col("name").startswith(FRAMEWORK_PREFIX), "framework").otherwise("listing")
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    return sets.select(F.concat(F.lit(f"{folder}/"), F.col("name")).alias("path"), "length", role.alias("role"), suffix.alias("format"))


def read_set(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, list[str]]:
    """The rows of a file set under its own headers, and the columns of their order."""
    if kind == "parquet":
        return with_file_order(spark.read.parquet(path)), FILE_ORDER
    names = csv_header(spark, path)
    # Headers may repeat or be empty: the cells are read by place.
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = csv_rows(csv_records(spark, path), cells)
    return rows.select("cells.*", *CSV_ORDER).toDF(*names, *CSV_ORDER), CSV_ORDER


def folder_stamp(spark: SparkSession) -> str:
    """The stamp of an upload that begins now."""
    return spark.range(1).select(run_stamp(F.current_timestamp())).first()[0]


def ingest_folder(
    spark: SparkSession,
    folder: str,
    alias: str,
    root: str,
    stamp: str | None = None,
    required: list[str] | None = None,
    max_mb: int = 100,
) -> tuple[bool, str]:
    """Checks and stores the upload that lies in a folder: one framework and one
    listing, as CSV or Parquet. Files are read once and kept as Parquet under
    `incoming`; checks and cleaning work on that. Returns whether the upload
    passed, and its run stamp (made now where none is given)."""
    stamp = stamp or folder_stamp(spark)
    sets = file_sets(spark, folder)
    rule = F.when(F.col("length") == 0, "empty_file").when(~F.col("format").isin(*FORMATS), "format")
    rules = sets.withColumn("rule", rule)
    # A name in a folder that people fill: the first readable one of each role.
    readable = rules.where("rule IS NULL").groupBy("role").agg(F.min(F.struct("path", "format")).alias("set"))
    found = {r["role"]: r["set"] for r in readable.collect()}
    if len(found) < 2:
        write_parquet(set_report(rules), f"{root}/report/run_ts={stamp}")
        return False, stamp
    tables, orders, files = {}, {}, {}
    for role, (path, kind) in found.items():
        rows, orders[role] = read_set(spark, path, kind)
        kept = f"{root}/incoming/role={role}/run_ts={stamp}"
        write_parquet(rows, kept)
        tables[role] = spark.read.schema(rows.schema).parquet(kept)
        files[role] = sets.where(F.col("path") == path)
    upload = Upload(
        framework=tables["framework"],
        listing=tables["listing"],
        framework_files=files["framework"],
        listing_files=files["listing"],
        alias=alias,
        order=orders["listing"],
        framework_order=orders["framework"],
        required=required or list(REQUIRED),
        max_mb=max_mb,
    )
    return ingest(upload, root, stamp), stamp


def set_report(rules: DataFrame) -> DataFrame:
    """A report of nothing but files: the sets that break a rule, and the roles
    that no readable set plays."""
    bad = rules.where("rule IS NOT NULL").groupBy(F.col("role").alias("dataset"), "rule").agg(F.count("*").alias("n_bad"))
    every = rules.sparkSession.createDataFrame([("framework",), ("listing",)], "role string")
    missing = every.join(rules.where("rule IS NULL").select("role").distinct(), "role", "left_anti")
    missing = missing.select(F.col("role").alias("dataset"), F.lit("missing_file").alias("rule"), F.lit(1).cast("bigint").alias("n_bad"))
    message = F.create_map(*[F.lit(x) for pair in FILE_MESSAGES.items() for x in pair])[F.col("rule")]
    return bad.unionByName(missing).select("dataset", "rule", F.lit("*").alias("column"), "n_bad", message.alias("message"))
