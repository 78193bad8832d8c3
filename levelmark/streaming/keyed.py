"""First rows per key over a stream, remembered on the state store.

The state holds one flag per key and is looked up, never read as a whole. Before
the shuffle every Arrow batch keeps one row per key, so a key holding most of the
arriving rows brings few of them to its task.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from levelmark.schemas import FILE_ORDER

#: The state store that keyed state needs; its data lie on disk, not in the heap.
PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PACKED = "key string, src_file string, src_row bigint, row string"


class FirstSeen(StatefulProcessor):
    """Lets the first row of a key pass, in file order, and none after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            found = frame.sort_values(FILE_ORDER, kind="stable").iloc[:1]
            if first is None or tuple(found[FILE_ORDER].iloc[0]) < tuple(first[FILE_ORDER].iloc[0]):
                first = found
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def one_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row per key of each batch."""
    for batch in batches:
        if batch.num_rows:
            order = pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in ("key", *FILE_ORDER)])
            batch = batch.take(order)
            keys = batch.column("key")
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(new))
        yield batch


def key_of(*columns: str):
    """One text per combination of values; null differs from every text."""
    return F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in columns))), 256)


def first_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the stream that are first of their key (`row`, as JSON); a
    batch's first is the one that comes first in file order."""
    packed = rows.select(key_of(*keys).alias("key"), *FILE_ORDER, F.to_json(F.struct(*rows.columns)).alias("row"))
    packed = packed.mapInArrow(one_per_batch, PACKED)
    return packed.groupBy("key").transformWithStateInPandas(FirstSeen(), PACKED, "Append", "None")


def unpacked(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(F.from_json("row", schema).alias("r")).select("r.*")


class on_keyed_state:
    """Sets the session's state store for the queries started inside."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(PROVIDER_SETTING, None)
        self.conf.set(PROVIDER_SETTING, PROVIDER)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.conf.unset(PROVIDER_SETTING)
        else:
            self.conf.set(PROVIDER_SETTING, self.before)
