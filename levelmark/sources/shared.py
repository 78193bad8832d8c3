"""Folders that driver and executors share."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; where none is set, a folder
    below the session's table store, which on a cluster must not be a local one."""
    path = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    store = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if store.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that the driver and all executors share: {store} is local to each")
    return f"{store}/shared"


def own_dir(spark: SparkSession) -> str:
    """What this application writes on the way lies here."""
    return f"{shared_dir(spark)}/levelmark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a folder in any store that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def released(spark: SparkSession) -> bool:
    """Removes all that the application has written on the way; to be called when
    nothing of it is read any more."""
    return remove(spark, own_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the frame to the shared folder and reads it back: cuts lineage
    and survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_present(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Table at `path`, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
