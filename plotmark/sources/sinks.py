"""Table outputs (K1-K7) and the work ledger."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] | str) -> None:
    """One folder per key value in a single job (K1, K2).

    Rebalancing gathers the rows of a value so that few files are written, and
    Spark splits a value that is too large for one task.
    """
    by = [by] if isinstance(by, str) else list(by)
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Add result rows, each stamped with the time of the run."""
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def publish_run(df: DataFrame, path: str, run_id: str, stamp: bool = False) -> None:
    """Append rows under a run id so that the append may be repeated.

    The rows are staged in a folder of this attempt, which no reader looks at, and then published
    by one small manifest that names it. A repeated run names its own folder instead, so its rows
    replace those of the run before; a run that failed halfway has no manifest and no rows.
    """
    if not run_id or any(c in run_id for c in "/\\ :"):
        raise ValueError(f"a run id names a file: {run_id!r}")
    spark = df.sparkSession
    attempt = f"attempt-{uuid.uuid4().hex}"
    rows = df.withColumn("written_at", F.current_timestamp()) if stamp else df
    rows.write.parquet(f"{path}/{attempt}")
    final, fs = _file_system(spark, f"{path}/_published/{run_id}.json")
    staged, _ = _file_system(spark, f"{path}/_staged/{run_id}-{attempt}.json")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps({"run": run_id, "folder": attempt}).encode()))
    out.close()
    fs.mkdirs(final.getParent())
    # One rename replaces a manifest as a whole; it works within the file system of the path.
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(staged, final, options)


def read_runs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of all published runs, with their ``run``; ``schema`` is for a table without runs.

    The manifests, one line a run, are read by Spark; folders of failed or replaced attempts are not.
    """
    folder, fs = _file_system(spark, f"{path}/_published")
    found = [] if not fs.exists(folder) else [
        r for r in spark.read.schema("run string, folder string").json(f"{path}/_published/[!_.]*.json").collect()
    ]
    if not found:
        if schema is None:
            raise FileNotFoundError(f"no run is published under {path}")
        return spark.createDataFrame([], f"{schema}, run string")
    tables = spark.read.option("mergeSchema", True).parquet(*[f"{path}/{r.folder}" for r in found])
    names = spark.createDataFrame([(r.folder, r.run) for r in found], "_folder string, run string")
    at = F.regexp_extract(F.input_file_name(), "(attempt-[0-9a-f]{32})", 1)
    return tables.withColumn("_folder", at).join(F.broadcast(names), "_folder").drop("_folder")


def anti_ledger(work: DataFrame, *ledgers: DataFrame, key: str, skip: Sequence[str] = (), skip_column: str | None = None) -> DataFrame:
    """Work items found in none of the ledgers, less the values to skip."""
    for ledger in ledgers:
        work = work.join(ledger.select(key), key, "left_anti")
    if skip:
        column = F.col(skip_column or key)
        work = work.filter(F.coalesce(~column.isin(*skip), F.lit(True)))
    return work
