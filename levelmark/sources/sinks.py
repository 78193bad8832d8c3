"""Writing inputs, results, CSV exports and conversions."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelmark.reference_values import RESULT_TITLES
from levelmark.sources import versions
from levelmark.sources.csv_records import csv_records, csv_rows

#: Tables of an upload, each by run stamp.
STAMP_COLUMN = "run_ts"
INPUT_TABLES = ["role=framework", "role=listing", "report", "rejected"]
STAMP_FORMAT = "yyyyMMdd_HHmm"  # fixed value
BAD_RECORD = "_bad_record"


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """An empty frame is a valid table."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def run_stamp(moment: Column) -> Column:
    return F.date_format(moment, STAMP_FORMAT)


def write_inputs(framework: DataFrame, listing: DataFrame, root: str, stamp: str) -> None:
    """Both inputs under their role and run stamp; other runs stay untouched."""
    for role, df in (("framework", framework), ("listing", listing)):
        write_parquet(df, f"{root}/role={role}/run_ts={stamp}")


def clear_inputs(spark: SparkSession, root: str) -> None:
    """Empties what an upload has stored under `root`, all its run stamps; schemas stay."""
    for kind in INPUT_TABLES:
        try:
            stored = spark.read.parquet(f"{root}/{kind}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        columns = [f for f in stored.schema.fields if f.name != STAMP_COLUMN]
        for row in stored.select(STAMP_COLUMN).distinct().collect():  # one row per upload
            write_parquet(spark.createDataFrame([], T.StructType(columns)), f"{root}/{kind}/{STAMP_COLUMN}={row[0]}")


def write_buckets(df: DataFrame, path: str) -> None:
    """One pass over a frame holding all buckets. The whole table is replaced,
    so that a bucket that has become empty keeps no rows of an earlier run."""
    df.write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_results(df: DataFrame, root: str, alias: str) -> None:
    """Buckets of one sector, all at once: readers find the former results or
    these. The other sectors stay untouched."""
    versions.publish(df, root, alias)


def write_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000, compression: str = "none") -> None:
    """Header in every part file; parts are written in parallel, in files of bounded
    length. gzip at its fastest level: the others take several times as long for little less."""
    (
        df.write.mode("overwrite")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", compression)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def result_name(bucket: Column, alias: str) -> Column:
    """Display title of a published result."""
    name = F.lit(None).cast("string")
    for key, title in RESULT_TITLES.items():
        name = F.when(bucket == key, title % alias).otherwise(name)
    return name


def convert_csv(spark: SparkSession, source: str, schema: T.StructType, target: str) -> DataFrame:
    """CSV files, a folder or a glob to one Parquet table. Every row keeps its
    file; malformed lines are kept with their text instead of ending the job."""
    kept = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    rows = csv_rows(csv_records(spark, source), kept, BAD_RECORD).select("cells.*", "src_file")
    write_parquet(rows, target)
    return spark.read.parquet(target)


def conversion_report(converted: DataFrame, by: Column) -> DataFrame:
    """Good and malformed lines per file or folder."""
    bad = F.col(BAD_RECORD).isNotNull()
    return converted.groupBy(by.alias("source")).agg(
        F.count_if(~bad).alias("n_good"), F.count_if(bad).alias("n_bad")
    )
