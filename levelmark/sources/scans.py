"""Reading frameworks, listings, results and file listings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.schemas import FRAMEWORK_COLUMNS, LISTING_COLUMNS, listing_schema, shorten
from levelmark.sources.csv_records import csv_records, csv_rows
from levelmark.sources.folder_files import folder_files
from levelmark.sources.versions import read_current

# Framework files start with the prefix, listings do not (path globs).
FRAMEWORK_GLOB = "SFW*.parquet"
LISTING_GLOB = "{[!S]*,S,S[!F]*,SF,SF[!W]*}.parquet"


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A missing path is an error; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def with_file_order(df: DataFrame) -> DataFrame:
    """Adds the position of each row in its Parquet file."""
    return df.select("*", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.row_index").alias("src_row"))


def read_framework(spark: SparkSession, folder: str) -> DataFrame:
    """Framework file of an input folder, in package names."""
    df = with_file_order(spark.read.parquet(f"{folder}/{FRAMEWORK_GLOB}"))
    return shorten(df, FRAMEWORK_COLUMNS)


def read_listing(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Listing file of an input folder: only the wanted published columns."""
    names = columns or list(LISTING_COLUMNS)
    df = with_file_order(spark.read.parquet(f"{folder}/{LISTING_GLOB}"))
    return shorten(df.select(*[f"`{c}`" for c in names], "src_file", "src_row"), LISTING_COLUMNS)


def read_role(spark: SparkSession, root: str, role: str) -> DataFrame:
    """One role of the stored inputs, all its run stamps."""
    return spark.read.parquet(f"{root}/role={role}")


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with header; cells may hold line breaks, quotes and edge spaces. A
    file of any size is read by as many tasks as it has splits."""
    schema = schema or listing_schema()
    return csv_rows(csv_records(spark, path), schema).select("cells.*")


def read_results(spark: SparkSession, root: str, bucket: str | None = None) -> DataFrame:
    """Current results of all sectors; a bucket reads only its own folders (partition pruning)."""
    df = read_current(spark, root, "sector")
    return df.where(F.col("bucket") == bucket) if bucket else df


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files as rows, empty ones too: path, length, modificationTime. The
    contents are never read."""
    return folder_files(spark, folder, pattern, recursive)


def latest_file(files: DataFrame, by_time: bool = False) -> DataFrame:
    """Last file by name, or by time and then name."""
    rank = F.struct("modificationTime", "path") if by_time else F.col("path")
    return files.agg(F.max_by("path", rank).alias("path"))


def size_check(files: DataFrame, max_mb: int = 100) -> DataFrame:
    """Adds `size_ok`: the file is not larger than the limit."""
    return files.withColumn("size_ok", F.col("length") <= F.lit(max_mb * 1024 * 1024))
