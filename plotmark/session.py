"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# All intermediate tables of this driver process share one folder.
RUN = uuid.uuid4().hex


def local_session(cores: int | str = 8, name: str = "plotmark") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local master."""
    shared = spark.conf.get(CHECKPOINT_KEY, None)
    if shared:
        return shared
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError(f"{CHECKPOINT_KEY} is not set: intermediate tables need a shared folder")
    folder = context.getCheckpointDir()
    if folder is None:
        folder = tempfile.mkdtemp(prefix="plotmark-")
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/plotmark-{RUN}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this run's intermediate tables, once its results have been written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark).rstrip('/')}/plotmark-{RUN}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the scratch folder and read it back, which cuts its lineage.

    A Parquet copy outlives lost executors, can be scanned by column, and has a
    known size, so later joins are planned from a measured size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a written intermediate table that nothing reads any more."""
    spark = table.sparkSession
    folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
    for name in folders:
        if f"/plotmark-{RUN}/" in name:
            folder = spark._jvm.org.apache.hadoop.fs.Path(name)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bytes_of(table: DataFrame) -> int:
    """Bytes of the files behind a written table, from their listing."""
    spark = table.sparkSession
    total = 0
    for name in table.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def materialize_counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Like ``materialize``, with aggregates taken while the table is written."""
    seen = Observation()
    table = materialize(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), name)
    return table, seen.get
