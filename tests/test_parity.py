"""Row and group rules on hand-made edge cases."""

import pytest
from pyspark.sql import functions as F

from plotmark.functions import scalars as S
from plotmark.functions.status import cutoff_status, fuse_status
from plotmark.operators import areas, records, summaries
from plotmark.sources import contracts, layout, sinks


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_cutoff_edges(spark):
    shares = [0.0, 0.19, 0.2, 0.59, 0.6, 1.0, None]
    assert column(spark, shares, "double", cutoff_status("x")) == [0, 0, 9, 9, 1, 1, 10]


def test_fuse_every_pair(spark):
    codes = [0, 1, 9, 10]
    df = spark.createDataFrame([(a, b) for a in codes for b in codes], "a int, b int")
    got = {(r.a, r.b): r.f for r in df.withColumn("f", fuse_status("a", "b")).collect()}
    for (a, b), f in got.items():
        yes, no = 1 in (a, b), 0 in (a, b)
        assert f == (9 if yes == no else 1 if yes else 0)


def test_ratio_age_and_caps(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0, 2000, 2001, 7.0), (0.05, 1.0, 2001, 2000, None), (0.5, 1.0, 2000, 2000, 3.0)],
        "a double, b double, sold int, built int, rooms double",
    )
    rows = df.select(
        S.ratio_in_range("a", "b", 0, 0.1).alias("r"), S.age_at("sold", "built").alias("age"), S.top_code("rooms", 5).alias("cap")
    ).collect()
    assert [tuple(r) for r in rows] == [(None, None, 5.0), (0.05, 1, None), (None, 0, 3.0)]


def test_half_even_percent(spark):
    assert column(spark, [0.125, 0.135, 0.345], "double", S.percent("x")) == pytest.approx([12, 14, 34])


def test_zip_and_padding(spark):
    raw = ["1234", "01234-5678", "1234.0", "123456", None]
    assert column(spark, raw, "string", S.clean_zip("x")) == ["01234", "01234", "01234", "123456", None]


def test_metro_name(spark):
    city, state = S.split_metro_name("x", {"A": "B"})
    assert column(spark, ["A-C, TX-OK Metro", "Bend, OR"], "string", F.concat_ws("|", city, state)) == ["B|TX", "Bend|OR"]


def test_geography_keys(spark):
    assert column(spark, ["48113"], "string", S.gisjoin_county("x")) == ["G4801130"]
    assert column(spark, ["481130001002003"], "string", S.blockgroup_id("x")) == ["481130001020"]
    assert column(spark, ["G48011300012003"], "string", S.blockgroup_from_gisjoin("x")) == ["481130012003"]


def test_day_numbers(spark):
    days = column(spark, ["1960-01-01", "2004-12-20", "junk", None], "string", S.day_number("x"))
    assert days == [0, S.SALES_FROM_DAY, None, None]


def test_not_in_passes_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r.x for r in df.filter(S.not_in("x", ["a"])).collect()} == {"b", None}


def test_nan_is_missing(spark):
    df = layout.nan_to_null(spark.createDataFrame([(float("nan"),), (2.0,)], "x double"))
    assert df.agg(F.avg("x"), F.count("x")).first() == (2.0, 1)


def test_first_per_key_is_deterministic(spark):
    rows = [(1, 2, "b"), (1, 1, "z"), (1, 1, "a"), (2, 5, None), (None, 0, "n")]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "k int, seq int, v string").repartition(parts)
        got = {r.k: r.v for r in records.first_per_key(df, "k", ["seq"]).collect()}
        assert got == {1: "a", 2: None, None: "n"}
    with pytest.raises(ValueError):
        records.first_per_key(df, "k", [])
    known = records.first_per_key(df, "k", ["seq"], not_null="v")
    assert {r.k for r in known.collect()} == {1, None}


def test_child_flag_modes(spark):
    df = spark.createDataFrame([(1, 1, "X"), (1, 2, "VWL"), (2, 1, "VWL")], "k int, seq int, code string")
    flags = {"w": F.col("code") == "VWL"}
    assert dict(records.child_flag(df, "k", flags).collect()) == {1: 1, 2: 1}
    assert dict(records.child_flag(df, "k", flags, "first", ["seq"]).collect()) == {1: 0, 2: 1}


def test_ever_flag_unknown_when_never_observed(spark):
    df = spark.createDataFrame([(1, True, False), (1, False, True), (2, True, False), (3, False, True), (None, True, True)], "k int, f boolean, o boolean")
    got = {r.k: r.status for r in records.ever_flag(df, "k", {"f": F.col("f")}, F.col("o")).collect()}
    assert got == {1: 1, 2: None, 3: 0}


def test_coverage_filter(spark):
    rows = [("a", "r", 0)] * 6 + [("b", "r", 0)] * 3 + [("c", "r", 1)] + [("d", "s", 0)] + [("e", "t", None)] + [(None, "r", 1)] + [("f", None, 0)]
    df = spark.createDataFrame(rows, "area string, region string, v int")
    kept = areas.coverage_filter(df, "v", "area", "region", 5)
    # a: large and never flagged; d: its region is never flagged; e: rate unknown; f: region unknown.
    assert {r.area for r in kept.collect()} == {"b", "c", "e", "f"}


def test_mode_takes_smallest_on_tie(spark):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("a", 5), ("a", 3), ("b", 9), (None, 1)], "g string, v int")
    assert {r.g: r.mode for r in areas.group_mode(df, ["g"], "v").collect()} == {"a": 3, "b": 9}
    assert areas.near_mode(df, ["g"], "v", 1).count() == 3


def test_group_share_guards(spark):
    rows = [("a", 1)] * 5 + [("b", 1)] * 4 + [("n", 1)] * 9 + [(None, 1)] * 9
    df = areas.group_share(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", "s", 5, exclude=F.col("g") == "n")
    assert {(r.g, r.s) for r in df.collect()} == {("a", 1.0), ("b", None), ("n", None), (None, None)}
    assert df.count() == len(rows)


def test_usable_columns(spark):
    df = spark.createDataFrame([("m", 1, "x", None), ("m", 2, "x", 1.0), ("k", 1, "x", 1.0), ("k", 1, "y", 2.0)], "g string, a int, b string, c double")
    got = {r.g: r.usable for r in areas.usable_columns(df, "g", ["a", "b", "c"]).collect()}
    assert got == {"m": ["a"], "k": ["b", "c"]}


def test_interaction_keeps_missing(spark):
    df = summaries.interact(spark.createDataFrame([(1, None), (None, 2.0), (1, 2.0)], "t int, v double"), "t", ["v"])
    assert [r.t_x_v for r in df.collect()] == [None, None, 2.0]


def test_unique_contract(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        contracts.assert_unique(df, ["k"])
    with pytest.raises(ValueError):
        contracts.lookup(df, df.select("k", F.col("v").alias("w")), "k")


def test_levels_over_the_limit_are_an_error(spark):
    with pytest.raises(ValueError):
        summaries.levels_of(spark.range(12), "id", limit=10)


def test_ledger_skips_values_but_not_null(spark):
    work = spark.createDataFrame([("a", "AZ"), ("b", "TX"), ("c", None), ("d", "TX")], "k string, s string")
    done = spark.createDataFrame([("d",)], "k string")
    assert {r.k for r in sinks.anti_ledger(work, done, key="k", skip=["AZ"], skip_column="s").collect()} == {"b", "c"}


def test_layout_must_be_complete(spark):
    bad = spark.createDataFrame([("t", 0, "a", "str"), ("t", 2, "b", "str")], "table_name string, position int, field_name string, data_type string")
    with pytest.raises(ValueError):
        layout.schema_from_layout(bad, "t")


def test_weighted_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (3.0, 2.0)], "x double, w double")
    assert summaries.weighted_mean(df, ["x"], "w").first().x == 2.0
