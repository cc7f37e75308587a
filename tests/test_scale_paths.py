"""Paths meant for large or uneven data give the same answers as the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotmark.models import moments
from plotmark.operators import sampling, skew, summaries
from plotmark.sources import contracts


def uneven(spark, n=3000, seed=1):
    """A third of the rows in one group, a third without a key, many small groups."""
    rng = np.random.default_rng(seed)
    key = np.where(np.arange(n) % 3 == 0, "hot", [f"g{k}" for k in rng.integers(0, 200, n)])
    pdf = pd.DataFrame({"k": key, "v": rng.normal(size=n).round(3)})
    df = spark.createDataFrame(pdf)
    return df.withColumn("k", F.when(~F.col("v").between(-0.3, 0.3), F.col("k")))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_join_equals_broadcast(spark, monkeypatch, how):
    df = uneven(spark)
    stats = df.dropna(subset=["k"]).groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    plain = skew.attach_groups(df, stats, ["k"], "n", how).toPandas()
    monkeypatch.setattr(skew, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(skew, "HEAVY_GROUPS", 3)
    split = skew.attach_groups(df, stats, ["k"], "n", how).toPandas()
    order = ["k", "v", "m"]
    pd.testing.assert_frame_equal(plain.sort_values(order, ignore_index=True), split.sort_values(order, ignore_index=True))


def test_large_lookup_equals_broadcast(spark):
    df = uneven(spark)
    dim = df.dropna().select("k").distinct().withColumn("code", F.length("k"))
    small = contracts.lookup(df, dim, "k").toPandas()
    large = contracts.lookup(df, dim, "k", max_bytes=0).toPandas()
    order = ["k", "v"]
    pd.testing.assert_frame_equal(small.sort_values(order, ignore_index=True), large.sort_values(order, ignore_index=True), check_dtype=False)


@pytest.mark.parametrize("how", ["left", "inner", "right", "full", "left_semi", "left_anti"])
def test_lookup_has_one_contract(spark, how):
    """Columns, rows and refusals do not depend on the sizes."""
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k int, row string")
    dim = spark.createDataFrame([("x", 2, "n"), ("y", 3, "m")], "z string, k int, name string")
    found = []
    for limit in (0, None):
        try:
            out = contracts.lookup(df, dim, "k", how, max_bytes=limit)
            found.append((out.columns, sorted(map(str, out.collect()))))
        except ValueError as e:
            found.append(str(e))
        with pytest.raises(ValueError):
            contracts.lookup(df, dim.withColumnRenamed("name", "row"), "k", max_bytes=limit)
    assert found[0] == found[1]
    if how in ("left", "inner"):
        assert found[0][0] == ["k", "row", "z", "name"]


def test_batches_give_one_triangle_per_group_and_task(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(20_000, 3)), columns=list("abc"))
    pdf["k"] = rng.integers(0, 1000, len(pdf))
    df = spark.createDataFrame(pdf).repartition(4)
    products = moments.batch_products(df, ["k"], ["a", "b", "c"])
    assert products.count() <= 4 * 1000 * 6
    sums = products.filter("i = 0 AND j = 1").groupBy("k").agg(F.sum("s").alias("s")).toPandas().set_index("k").s
    np.testing.assert_allclose(sums.sort_index(), (pdf.a * pdf.b).groupby(pdf.k).sum(), atol=1e-9)


@pytest.mark.parametrize("ties", [False, True])
def test_percentiles_through_brackets(spark, monkeypatch, ties):
    """With a coarse sketch the brackets are real; the result stays exact."""
    monkeypatch.setattr(summaries, "SKETCH", 100)
    df = uneven(spark, 6000)
    if ties:
        df = df.withColumn("v", F.round("v", 0))
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = summaries.exact_percentiles(df, ["k"], "v", probs).toPandas().set_index("k")
    pdf = df.toPandas().dropna()
    for k, part in pdf.groupby("k"):
        want = np.percentile(part.v, [10, 50, 99])
        np.testing.assert_allclose(got.loc[k, list(probs)].astype(float), want, atol=1e-12)
    overall = summaries.exact_percentiles(df, [], "v", probs).first()
    np.testing.assert_allclose(list(overall), np.percentile(df.toPandas().v, [10, 50, 99]), atol=1e-12)


def test_sample_does_not_depend_on_partitions(spark):
    ids = spark.range(5000)
    one = {r.id for r in sampling.sample_n(ids.repartition(1), "id", 300, 5).collect()}
    many = {r.id for r in sampling.sample_n(ids.repartition(13), "id", 300, 5).collect()}
    assert one == many and len(one) == 300
    assert {r.id for r in sampling.sample_n(ids, "id", 9000, 5).collect()} == set(range(5000))


def test_sampled_groups_are_whole(spark):
    df = uneven(spark)
    drawn = sampling.sample_groups(df, "k", 10, 2)
    counts = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    got = {r.k: r["count"] for r in drawn.groupBy("k").count().collect()}
    assert len(got) == 10 and all(counts[k] == n for k, n in got.items())


def test_scratch_tables_lie_in_one_folder_and_can_be_dropped(spark, monkeypatch, tmp_path):
    from plotmark import session

    assert session.scratch_dir(spark) == session.scratch_dir(spark)
    monkeypatch.setattr(session, "scratch_dir", lambda _: str(tmp_path))
    assert session.materialize(spark.range(3), "t").count() == 3
    assert len(list(tmp_path.glob(f"plotmark-{session.RUN}/t-*"))) == 1
    session.drop_scratch(spark)
    assert not list(tmp_path.glob("plotmark-*"))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from plotmark import session

    class Conf:
        def get(self, key, default):
            return self.value

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere"

    Conf.value = None
    with pytest.raises(RuntimeError):
        session.scratch_dir(Session())
    Conf.value = "hdfs://shared/folder"
    assert session.scratch_dir(Session()) == "hdfs://shared/folder"


@pytest.mark.parametrize("by", [["k"], []])
def test_percentiles_by_digits_order_no_values(spark, monkeypatch, by):
    """Beyond the limit no task orders values; answers are those of NumPy."""
    rng = np.random.default_rng(8)
    n = 6000
    v = np.concatenate([rng.normal(size=n // 2), np.exp(rng.normal(scale=200, size=n // 3)), np.repeat([-0.0, 0.0, 7.5, -1e300], n // 24)])
    pdf = pd.DataFrame({"k": np.where(np.arange(n) % 3 == 0, "hot", [f"g{k}" for k in rng.integers(0, 40, n)]), "v": rng.permutation(v)})
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(summaries, "ORDERED_VALUES", 0)
    monkeypatch.setattr(summaries, "_by_order", None)
    probs = {"least": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "most": 1.0}
    got = summaries.exact_percentiles(df, by, "v", probs).toPandas()
    parts = pdf.groupby("k") if by else [(None, pdf)]
    for k, part in parts:
        want = np.percentile(part.v, [100 * p for p in probs.values()])
        row = got[got.k == k].iloc[0] if by else got.iloc[0]
        np.testing.assert_allclose(row[list(probs)].to_numpy(float), want, rtol=1e-12)


def test_percentiles_of_nothing_and_of_one_value(spark, monkeypatch):
    monkeypatch.setattr(summaries, "ORDERED_VALUES", 0)
    df = spark.createDataFrame([("a", 2.5), ("b", None), (None, 1.0)], "k string, v double")
    assert list(map(tuple, summaries.exact_percentiles(df, ["k"], "v", {"m": 0.5}).collect())) == [("a", 2.5)]
    assert summaries.exact_percentiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_bits_order_as_doubles_do(spark):
    rng = np.random.default_rng(2)
    v = np.frombuffer(rng.bytes(8 * 20_000), dtype=np.float64)
    exact = [2.0**k for k in range(-1074, 1024)] + [np.nextafter(2.0**k, 0) for k in range(-1000, 1024)]
    v = np.concatenate([v[~np.isnan(v)], exact, [-x for x in exact], [0.0, np.inf, -np.inf, 1.7976931348623157e308]])
    got = spark.createDataFrame(pd.DataFrame({"v": v})).withColumn("bits", summaries.ordered_bits(F.col("v"))).toPandas()
    bits = got.v.to_numpy().view(np.int64)
    assert (got.bits.to_numpy() == np.where(bits < 0, -(bits & 0x7FFFFFFFFFFFFFFF), bits)).all()
