"""Shards along a Hilbert curve over document metadata.

Several metadata columns are quantised into cells of equal counts; a row's cells
are its place in a cube, and the Hilbert curve through the cube gives each place
a number, near places near numbers. Rows sorted by that number are cut into runs.
A run spans a small range of every dimension, so that min/max statistics of its
files prune on any of them.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelmark.llm.common import ROW_KEYS, row_keys, running_totals, text_or_empty
from levelmark.operators.joins import lookup_join
from levelmark.sources.shared import written

SHARDS = 8
BITS = 8
#: Equal texts up to this part of a shard's even share stay in one shard.
WHOLE_GROUP = 1 / 32


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of points with `bits` bits on each axis
    (the transposed form of Skilling, AIP Conf. Proc. 707, 2004)."""
    x = [np.array(a, dtype=np.uint64) for a in axes]
    one, zero = np.uint64(1), np.uint64(0)
    for bit in range(bits - 1, 0, -1):
        flag, below = one << np.uint64(bit), (one << np.uint64(bit)) - one
        for axis in range(len(x)):
            set_ = (x[axis] & flag) != zero
            swap = np.where(set_, zero, (x[0] ^ x[axis]) & below)
            x[0] = np.where(set_, x[0] ^ below, x[0] ^ swap)
            if axis:
                x[axis] = x[axis] ^ swap
    for axis in range(1, len(x)):
        x[axis] = x[axis] ^ x[axis - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flag = one << np.uint64(bit)
        turn = np.where((x[-1] & flag) != zero, turn ^ (flag - one), turn)
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for a in x:
            index = (index << one) | (((a ^ turn) >> np.uint64(bit)) & one)
    return index.astype(np.int64)


def _placed(rows: DataFrame, column: str, place: str) -> DataFrame:
    """Adds a number that orders the values as they are ordered; null comes first.

    A text's place is how many rows hold a smaller one, whatever its length."""
    kind = rows.schema[column].dataType
    if not isinstance(kind, T.StringType):
        return rows.withColumn(place, F.coalesce(F.col(column).cast("double"), F.lit(float("-inf"))))
    values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_rows"))
    ranked = running_totals(values, ["_value"], _before="_rows").select(F.col("_value").alias(column), F.col("_before").cast("double").alias(place))
    joined = lookup_join(rows, ranked, [column], "left", [c for c in rows.columns if c != column])
    return joined.withColumn(place, F.coalesce(place, F.lit(-1.0))).select(*rows.columns, place)


def curve(rows: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """`rows` with `hilbert`, the curve number of the columns `dims`.

    The cell borders of a dimension are 2^bits - 1 approximate quantiles of it
    over the rows given: few values or uneven ones spread as their counts do.
    """
    places = rows
    for i, d in enumerate(dims):
        places = _placed(places, d, f"_place{i}")
    places = written(places, "places")
    parts = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = places.agg(*(F.percentile_approx(f"_place{i}", parts, 4096).alias(f"c{i}") for i in range(len(dims)))).first()
    borders = [np.array(c if c is not None else [], dtype=np.float64) for c in cuts]

    @F.pandas_udf("long")
    def number(*columns: pd.Series) -> pd.Series:
        cells = [np.searchsorted(b, c.to_numpy(), side="left") for b, c in zip(borders, columns, strict=True)]
        return pd.Series(hilbert_index(cells, bits))

    return places.select(*rows.columns, number(*(f"_place{i}" for i in range(len(dims)))).alias("hilbert"))


def shard_layout(docs: DataFrame, shards: int = SHARDS, law: str = "bytes", dims: tuple[str, ...] = ("source", "lang", "size")) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot,
    grown_shard (null: this method has no `key` law), hilbert, ROW_KEYS.

    `size` is the text's UTF-8 bytes plus 1, null text as empty. `dims` are
    columns of `docs`, or `size`; nulls come first in a dimension. Law `bytes`
    cuts where the running bytes reach even shares; `rows` where the running
    count does, so counts are at most one apart. Equal texts lie side by side,
    placed by the metadata of the copy with the smallest id. Under `bytes` they
    share a shard if they take up to 1/32 of an even share; larger groups are
    cut like other rows. Ties in the order: text hash, then doc_id. Columns that
    are not named are not read; an empty table gives no rows.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"no law {law!r}")
    text = text_or_empty()
    own = [d for d in dims if d != "size"]
    slim = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_text"),
            *(F.col(d).alias(f"_dim_{d}") for d in own),
            *row_keys(),
        ),
        "slim",
    )
    same = ["_text", "text_crc32", "size"]
    by = [f"_dim_{d}" if d in own else d for d in dims]
    kept = F.min(F.struct("doc_id", *(f"_dim_{d}" for d in own))).alias("_first")
    groups = slim.groupBy(*same).agg(kept, F.count("*").alias("_n"))
    groups = groups.select(*same, "_n", *(F.col(f"_first._dim_{d}").alias(f"_dim_{d}") for d in own))
    groups = curve(written(groups, "groups"), by).select(*same, "hilbert", "_n", (F.col("size") * F.col("_n")).alias("_bytes"))
    groups = running_totals(groups, ["hilbert", *same], _bytes_before="_bytes", _rows_before="_n")

    rows = slim.select("doc_id", *same, *ROW_KEYS, F.lit(1).cast("long").alias("_one")).join(groups, same)
    rows = running_totals(rows, ["_rows_before", "doc_id", *ROW_KEYS], _rank="_one")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if law == "rows":
        reached, all_ = F.col("_rank"), total[1]
    else:
        # Twice the bytes, so that the middle of a row or group is a whole number.
        row = 2 * (F.col("_bytes_before") + (F.col("_rank") - F.col("_rows_before")) * F.col("size")) + F.col("size")
        group = 2 * F.col("_bytes_before") + F.col("_bytes")
        small = F.col("_bytes") <= total[0] * WHOLE_GROUP / shards
        reached, all_ = F.when(small, group).otherwise(row), 2 * total[0]
    shard = F.floor(reached.cast("decimal(25,0)") * shards / F.lit(max(all_, 1)).cast("decimal(25,0)")).cast("int")
    rows = rows.withColumn("shard", shard)
    first = F.broadcast(rows.groupBy("shard").agg(F.min("_rank").alias("_start")))  # one row per shard
    return rows.join(first, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        "shard",
        (F.col("_rank") - F.col("_start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
        *ROW_KEYS,
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "bytes", rows_per_file: int = 1_000_000) -> None:
    """Writes the documents as Parquet, a folder per shard, rows along the curve.
    The shard is column `_shard`, with more underscores where that is taken.

    Repeats of one row (id and text) go where the first of them goes."""
    shard = "_shard"
    while shard in docs.columns:
        shard = f"_{shard}"
    named = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # clear of the columns added on the way
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()), *row_keys())
    layout = shard_layout(docs, shards, law).groupBy(*ROW_KEYS).agg(F.min(F.struct("shard", "slot")).alias("_at"))
    placed = lookup_join(keyed, written(layout, "layout"), ROW_KEYS, "inner", ROW_KEYS)
    ordered = placed.repartitionByRange("_at.shard", "_at.slot").sortWithinPartitions("_at.shard", "_at.slot")
    ordered = ordered.select(*(F.col(n).alias(c) for c, n in named.items()), F.col("_at.shard").alias(shard))
    ordered.write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard).parquet(path)
