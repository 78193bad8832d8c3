"""Profiles of tables, folders and runs."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.functions.text import file_suffix
from levelmark.sources.folder_files import is_folder, opened
from levelmark.sources.scans import list_files

PUBLISHED_RESULTS = 3  # fixed value: valid, invalid, all tagged


FOOTERS = "path string, bytes bigint, n_rows bigint, n_row_groups int, n_columns int, column_names string"
CHUNKS = "path string, column_name string, codec string, n_rows bigint, n_nulls bigint, bytes bigint, low string, high string"


def _footer(path: str) -> pq.FileMetaData:
    system, inner, _ = opened(path)
    with system.open_input_file(inner) as f:
        return pq.ParquetFile(f).metadata


def _as_text(value) -> str | None:
    return None if value is None else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file in batch.to_pylist():
            m = _footer(file["path"])
            names = m.schema.to_arrow_schema().names
            values = file["path"], file["length"], m.num_rows, m.num_row_groups, len(names), ",".join(names)
            rows.append(dict(zip(("path", "bytes", "n_rows", "n_row_groups", "n_columns", "column_names"), values, strict=True)))
        yield pa.RecordBatch.from_pylist(rows, FOOTER_TYPES)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            m = _footer(path)
            for g in range(m.num_row_groups):
                group, rows = m.row_group(g), []
                for c in range(group.num_columns):
                    chunk = group.column(c)
                    known = chunk.statistics
                    low, high = (known.min, known.max) if known is not None and known.has_min_max else (None, None)
                    rows.append(
                        {
                            "path": path,
                            "column_name": chunk.path_in_schema,
                            "codec": chunk.compression.lower(),
                            "n_rows": group.num_rows,
                            "n_nulls": known.null_count if known is not None and known.has_null_count else None,
                            "bytes": chunk.total_compressed_size,
                            "low": _as_text(low),
                            "high": _as_text(high),
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, CHUNK_TYPES)


FOOTER_TYPES, CHUNK_TYPES = (
    pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[k]) for n, k in (f.split() for f in ddl.split(", "))])
    for ddl in (FOOTERS, CHUNKS)
)


def _parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a table (a folder or one file), spread over tasks."""
    folder, _, name = path.rstrip("/").rpartition("/")
    inside = list_files(spark, path) if is_folder(path) else list_files(spark, folder, name, recursive=False)
    return inside.where(F.col("path").endswith(".parquet")).select("path", "length").repartition("path")


def parquet_footers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a Parquet table, from the footers alone."""
    return _parquet_files(spark, path).mapInArrow(_footers, FOOTERS)


def parquet_profile(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes, row groups, rows and columns of a Parquet table; only
    footers are read, each by a task. Files with other columns than the most are counted."""
    files = parquet_footers(spark, path)
    columns = F.mode("column_names", True)
    found = files.agg(
        F.count("*").alias("n_files"),
        F.sum("bytes").alias("bytes"),
        F.sum("n_row_groups").alias("n_row_groups"),
        F.sum("n_rows").alias("n_rows"),
        columns.alias("column_names"),
        F.mode("n_columns", True).alias("n_columns"),
    )
    return found.select("n_files", "bytes", F.col("n_row_groups").cast("bigint").alias("n_row_groups"), "n_rows", "n_columns", "column_names")


def column_profile(spark: SparkSession, path: str) -> DataFrame:
    """Per column of a Parquet table: rows, nulls, bytes, codecs, and the least and
    largest value as the footers tell them (numbers compare as numbers; null where
    a file keeps none)."""
    chunks = _parquet_files(spark, path).mapInArrow(_chunks, CHUNKS)
    number = lambda c: F.col(c).try_cast("double")
    numeric = F.every(number("low").isNotNull() | F.col("low").isNull())
    low = F.when(numeric, F.min_by("low", number("low"))).otherwise(F.min("low"))
    high = F.when(numeric, F.max_by("high", number("high"))).otherwise(F.max("high"))
    return chunks.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_nulls").alias("n_nulls"),
        F.sum("bytes").alias("bytes"),
        F.array_join(F.array_sort(F.collect_set("codec")), ",").alias("codecs"),
        low.alias("low"),
        high.alias("high"),
    )


def frame_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, non-null rows; one pass."""
    counts = df.agg(F.count("*").alias("_all"), *[F.count(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns)])
    cells = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("kind"),
            F.col("_all").alias("n_rows"),
            F.col(f"_{i}").alias("n_filled"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*cells)))


def extension_counts(files: DataFrame) -> DataFrame:
    suffix = file_suffix(F.col("path"))
    return files.groupBy(suffix.alias("suffix")).agg(
        F.count("*").alias("n_files"), F.count_if(suffix.isin("csv", "xls", "xlsx")).alias("n_convertible")
    )


def run_complete(results: DataFrame) -> DataFrame:
    """All published results present, and nothing else?"""
    n = F.count_distinct("bucket")
    return results.agg(n.alias("n_results"), (n == PUBLISHED_RESULTS).alias("complete"))
