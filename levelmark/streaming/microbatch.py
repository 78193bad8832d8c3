"""Tags listing files as they arrive, one run per micro-batch.

The streaming checkpoint remembers which files were read, and the state store
which courses and skills, so a course and skill seen in an earlier batch is not
tagged again and no earlier batch is read for that. Answers are kept by work id:
a batch that is run again neither scores nor stores a row twice. Batches give what
one run over all files gives: the first row of a course and skill is tagged, with
the description in the first row of its course.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from levelmark.operators.listing import with_skill_key
from levelmark.plans.rounds import WORK_KEY
from levelmark.plans.runs import RunSettings, run_two_rounds
from levelmark.schemas import DESCRIPTION_COLUMNS, FILE_ORDER
from levelmark.sources.sinks import write_buckets, write_parquet
from levelmark.streaming.keyed import first_rows, on_keyed_state, unpacked

ARRIVED = "key string, src_file string, src_row bigint, row string, kind string"


def arriving(rows: DataFrame) -> DataFrame:
    """First rows per course and skill (`work`) and per course (`course`)."""
    keyed = with_skill_key(rows)
    work = first_rows(keyed, WORK_KEY).withColumn("kind", F.lit("work"))
    described = keyed.where("course_ref IS NOT NULL").select("course_ref", *DESCRIPTION_COLUMNS, *FILE_ORDER)
    return work.unionByName(first_rows(described, ["course_ref"]).withColumn("kind", F.lit("course")))


def stream_listing(
    spark: SparkSession, source: str, schema, framework: DataFrame, root: str, settings: RunSettings, prepare=None
) -> StreamingQuery:
    """Starts the stream over Parquet files in `source`; `prepare` makes the
    package's columns of the file's, row by row.

    Each batch has its own run folder and its own part of the tables `arrivals`,
    `descriptions` and `results`, which a repeat of the batch overwrites.
    """
    rows = (
        spark.readStream.schema(schema)
        .parquet(source)
        .select("*", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.row_index").alias("src_row"))
    )
    rows = prepare(rows) if prepare else rows
    columns = with_skill_key(rows).schema
    described = T.StructType([columns[c] for c in ("course_ref", *DESCRIPTION_COLUMNS)])

    def tag(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # Written in one pass: reading the batch twice would ask the state twice.
        write_parquet(batch, f"{root}/arrivals/batch={batch_id}")
        firsts = session.read.schema(ARRIVED).parquet(f"{root}/arrivals/batch={batch_id}")
        descriptions = unpacked(firsts.where("kind = 'course'"), described)
        write_parquet(descriptions, f"{root}/descriptions/batch={batch_id}")
        work = unpacked(firsts.where("kind = 'work'"), columns)
        if work.isEmpty():
            return
        known = session.read.schema(f"{described.toDDL()}, batch bigint").parquet(f"{root}/descriptions")
        known = known.where(F.col("batch") <= batch_id).drop("batch")
        results = run_two_rounds(session, framework, work, f"{root}/runs/{batch_id}", settings, descriptions=known)
        write_buckets(results, f"{root}/results/batch={batch_id}")

    with on_keyed_state(spark):
        return (
            arriving(rows)
            .writeStream.foreachBatch(tag)
            .option("checkpointLocation", f"{root}/stream")
            .trigger(availableNow=True)
            .start()
        )


def read_batches(spark: SparkSession, root: str, table: str) -> DataFrame:
    """`results`, `arrivals` or `descriptions` of all batches, with the batch number."""
    return spark.read.parquet(f"{root}/{table}")
