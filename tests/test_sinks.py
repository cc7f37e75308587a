"""Appends that are repeated or fail halfway leave each row once."""

import pytest
from pyspark.sql import functions as F

from plotmark.sources import sinks


def test_a_failed_run_leaves_nothing_and_a_repeated_one_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "results")
    good = spark.range(10).select(F.col("id"), F.lit(1.5).alias("coef"))
    broken = good.repartition(4).withColumn("coef", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("coef")))
    with pytest.raises(Exception, match="lost"):
        sinks.publish_run(broken, path, "monday")
    with pytest.raises(FileNotFoundError):
        sinks.read_runs(spark, path)
    assert sinks.read_runs(spark, path, "id long, coef double").columns == ["id", "coef", "run"]
    for _ in range(2):
        sinks.publish_run(good, path, "monday")
    sinks.publish_run(good.limit(3), path, "tuesday", stamp=True)
    with pytest.raises(Exception, match="lost"):
        sinks.publish_run(broken, path, "tuesday")
    got = sinks.read_runs(spark, path)
    assert got.count() == 13 and got.filter("run = 'monday'").select("id").distinct().count() == 10
    assert got.filter("written_at is not null").count() == 3


def test_ledger_of_runs(spark, tmp_path):
    """A repeated run leaves its own rows out of what is done, and so does the same work again."""
    path = str(tmp_path / "ledger")
    work = spark.range(20)
    for run in ("first", "second", "second"):
        done = sinks.read_runs(spark, path, "id long").filter(F.col("run") != run)
        left = sinks.anti_ledger(work, done, key="id")
        sinks.publish_run(left.orderBy("id").limit(8), path, run)
    ledger = sinks.read_runs(spark, path)
    assert sorted(r.id for r in ledger.filter("run = 'second'").collect()) == list(range(8, 16))
    assert ledger.count() == 16


def test_run_ids_name_files(spark, tmp_path):
    with pytest.raises(ValueError, match="run id"):
        sinks.publish_run(spark.range(1), str(tmp_path), "a/b")
