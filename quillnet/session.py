"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

# Settings the results depend on (time zone, ANSI) and settings that keep skewed joins splittable.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillnet")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillnet-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A temporary folder is used only for a local master without that setting.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="quillnet-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder.

    The state survives lost executors, the plan stays short, nothing is computed twice, and the
    size on disk tells Spark which side of a later join is small.
    """
    path = scratch_path(df.sparkSession, "state")
    df.write.parquet(path)
    state = df.sparkSession.read.schema(df.schema).parquet(path)
    state.written_to = path
    return state


def drop_state(state: DataFrame) -> None:
    """Deletes a table of :func:`cut_lineage` that nothing reads any more."""
    spark = state.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(state.written_to)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def next_state(df: DataFrame, *replaced: DataFrame) -> DataFrame:
    """The rows as a new state; the states they were made from are dropped."""
    state = cut_lineage(df)
    for old in replaced:
        drop_state(old)
    return state


def write_level(df: DataFrame, path: str, level: int) -> DataFrame:
    """The rows as one partition of a table with a partition per level, and read back."""
    where = f"{path}/level={level}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def read_levels(like: DataFrame, path: str) -> DataFrame:
    """All levels of a table of :func:`write_level`, with their number; the plan is the same for any number of levels."""
    schema = StructType([*like.schema.fields, StructField("level", IntegerType())])
    return like.sparkSession.read.schema(schema).parquet(path)
