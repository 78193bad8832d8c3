"""What several operators of this subpackage need."""

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelmark.operators.joins import lookup_join
from levelmark.sources.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Columns that tie a decision to the rows it was made for: two hashes of id and text.
ROW_KEYS = ["_row_key1", "_row_key2"]


def schema_with(df: DataFrame, added: str) -> T.StructType:
    """The frame's schema and the `added` columns (as DDL)."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept. Pure ASCII takes the fast way."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return (F.crc32(F.encode(text, "UTF-8")) % divisor).cast("int")


def row_keys(*also: str) -> list[Column]:
    """ROW_KEYS of doc_id, text and the columns in `also`; null differs from any value."""
    parts = [p for c in ("doc_id", "text", *also) for p in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts).alias(ROW_KEYS[0]), F.xxhash64(F.lit("second"), *reversed(parts)).alias(ROW_KEYS[1])]


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """`docs` without the rows named by `dropped` (ROW_KEYS and `spare`: whether
    one row of that name stays, the rest being its repeats). Columns of `docs` only.

    The names are broadcast where their measured size allows, else joined by a
    shuffle.
    """
    dropped = written(dropped, "dropped")
    named = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # clear of the columns added on the way
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()), *row_keys())
    gone = dropped.where(~F.col("spare")).select(*ROW_KEYS).distinct()
    kept = lookup_join(keyed, gone, ROW_KEYS, "left_anti", ROW_KEYS)
    repeated = dropped.where("spare").select(*ROW_KEYS).distinct()
    if not repeated.isEmpty():
        once = lookup_join(kept, repeated, ROW_KEYS, "left_semi", ROW_KEYS).dropDuplicates(ROW_KEYS)
        kept = lookup_join(kept, repeated, ROW_KEYS, "left_anti", ROW_KEYS).unionByName(once)
    return kept.select(*(F.col(n).alias(c) for c, n in named.items()))


#: Numbers that one row is exploded to at a time.
RANGE = 10_000


def exploded(df: DataFrame, first: Column, last: Column, name: str, block: int = RANGE) -> DataFrame:
    """A row for each whole number from `first` to `last` (none where that is
    smaller), as column `name`. Long ranges are cut, and their parts spread over
    tasks, before single numbers are made."""
    long_ = F.coalesce(last - first >= block, F.lit(False))
    few = df.where(~long_ & (first <= last)).withColumn(name, F.explode(F.sequence(first, last)))
    parts = df.where(long_).withColumn("_part", F.explode(F.sequence(first, last, F.lit(block).cast("long"))))
    # A stated number: the parts are small until they are numbers, and would be put together again.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(tasks, F.xxhash64(*df.columns, "_part"))
    many = parts.withColumn(name, F.explode(F.sequence(F.col("_part"), F.least(last, F.col("_part") + (block - 1))))).drop("_part")
    return few.unionByName(many)


def give_back() -> None:
    """Returns a worker's free memory to the system, after a task that held
    large tables of Python objects: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Characters of the texts that a worker holds as Python strings at a time.
SLICE_CHARS = 1_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The rows in parts whose texts have about `chars` characters together, with
    these texts (null as empty)."""
    for batch in batches:
        start, texts, size = 0, [], 0
        for i, value in enumerate(batch.column(text)):
            texts.append(value.as_py() or "")
            size += len(texts[-1])
            if size >= chars or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), texts
                start, texts, size = i + 1, [], 0


#: Bytes of an Arrow batch between Spark and a worker, in sessions that say nothing else.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Has the session send texts to its workers in batches of BATCH_BYTES, where
    it has not been told a smaller size. A batch is held several times, by the JVM
    while it grows and by the worker; operators work with any size."""
    if int(spark.conf.get(BATCH_SETTING).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def _sums_in_range(weights: dict[str, str]):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carry = dict.fromkeys(weights, 0)
        for batch in batches:
            names, columns = list(batch.schema.names), list(batch.columns)
            for out, weight in weights.items():
                own = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(own) + carry[out]
                names.append(out)
                columns.append(pa.array(ends - own))
                carry[out] = int(ends[-1]) if len(own) else carry[out]
            names.append("_range")
            columns.append(pa.array(np.full(batch.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names)

    return sums


def running_totals(df: DataFrame, order: list, **weights: str) -> DataFrame:
    """Adds for each `name=column` the sum of the column (whole numbers, no
    nulls) over all rows earlier in `order`, as column `name`.

    Rows are dealt out by ranges of the order, so that a key of any size spreads
    over tasks; each task sums its range. Only one total per range meets in one
    place. The result is stored, so reading it again gives the same rows.
    """
    added = [T.StructField(out, T.LongType(), False) for out in weights]
    schema = T.StructType([*df.schema.fields, *added, T.StructField("_range", T.IntegerType(), False)])
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.mapInArrow(_sums_in_range(weights), schema), "ranges")
    totals = ranged.groupBy("_range").agg(*(F.sum(w).alias(f"_own_{out}") for out, w in weights.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range", *(F.coalesce(F.sum(f"_own_{out}").over(earlier), F.lit(0)).alias(f"_start_{out}") for out in weights)
    )
    # One row per range, as many as the shuffle had partitions.
    joined = ranged.join(F.broadcast(starts), "_range")
    return joined.select(*df.columns, *((F.col(out) + F.col(f"_start_{out}")).alias(out) for out in weights))
