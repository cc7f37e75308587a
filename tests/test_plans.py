"""Physical plans: pruning, pushdown and joins."""

from pyspark.sql import functions as F, types as T

from checks import composites, effects, status, tables
from plotmark.models import linear
from plotmark.operators import records
from plotmark.plans.effects import regression_base
from plotmark.sources import layout


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(status.clean_sales(spark, sf))
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in plan and "LessThanOrEqual(o_totalprice,400000.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double,l_returnflag:string>" in plan_of(status.child_any(spark, sf))


def test_text_scan_parses_only_the_wanted_columns(spark, tmp_path):
    spark.range(5).selectExpr("id as a", "id as b", "id as c").write.option("sep", "|").csv(str(tmp_path / "t"))
    schema = T.StructType.fromDDL("a bigint, b bigint, c bigint")
    df = layout.read_delimited(spark, str(tmp_path / "t"), schema, columns=["b"])
    assert "ReadSchema: struct<b:bigint>" in plan_of(df) and df.agg(F.sum("b")).first()[0] == 10


def test_small_dimensions_are_broadcast(spark, sf):
    plan = plan_of(tables.crosswalk_joins(spark, sf))
    assert plan.count("BroadcastHashJoin") >= 2


def test_regression_reads_its_rows_once(spark, sf):
    plan = plan_of(effects.absorb_ols(spark, sf))
    assert plan.count("lineitem.parquet") == 1 and "Window" not in plan


def test_queries_use_no_cross_product(spark, sf):
    for df in (status.parcel_status(spark, sf), composites.wide_parcels(spark, sf), effects.grouped_ols(spark, sf)):
        assert "CartesianProduct" not in plan_of(df) and "BroadcastNestedLoopJoin" not in plan_of(df)


def test_grouped_fit_is_one_aggregation(spark, sf):
    fit = linear.ols(tables.table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"], by="l_suppkey")
    plan = plan_of(fit)
    assert plan.count("lineitem.parquet") == 1 and "FlatMapGroups" not in plan


def test_regression_base_reads_its_sales_once(spark):
    tx = "TransId long, RowID long, FIPS string, hoa int, hoa_neigh int, deed_type string, DocumentDate double, DataClassStndCode string, baths int"
    sales = spark.createDataFrame([(k, k % 4, "01001", k % 2, k % 3, "warranty", 20000.0, "H", 1 + k % 3) for k in range(12)], tx)
    parcels = spark.createDataFrame([(k, "010010001001001", f"s{k % 2}") for k in range(4)], "RowID long, PropertyAddressCensusTractAndBlock string, LegalSubdivisionName string")
    found = regression_base(sales, parcels, [], ["baths"])
    assert found.inputFiles() and all("/sales-" in f or "/groups-" in f for f in found.inputFiles())
    assert {(r.TransId, r.subdiv_size, r.baths_2, r.baths_3) for r in found.collect()} == {(k, 6, int(k % 3 == 1), int(k % 3 == 2)) for k in range(12)}


def test_child_flag_may_leave_out_keys_without_a_flag(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, None)], "k int, v string")
    flags = {"a": F.col("v") == "a", "c": F.col("v") == "c"}
    assert {tuple(r) for r in records.child_flag(df, "k", flags).collect()} == {(1, 1, 0), (2, 0, 0), (3, 0, 0)}
    assert {tuple(r) for r in records.child_flag(df, "k", flags, unset=False).collect()} == {(1, 1, 0)}
