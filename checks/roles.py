"""Stand-in roles of the supplied tables (see FIXTURES.md) in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL where SQL can state it."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    # Adding zero turns a rounded -0.0 into 0.0.
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


SQL_PUD = "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"
SQL_CONDO = "o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' AND o_totalprice < 100000"


def pud() -> Column:
    return F.expr(SQL_PUD)


def condo() -> Column:
    return F.expr(SQL_CONDO)


def observed() -> Column:
    return F.col("o_orderstatus").isin("F", "O")


# One row per customer with the ever-flagged status.
SQL_STATUS = f"""
status AS (
  SELECT o_custkey AS k,
         max(CASE WHEN {SQL_PUD} THEN 1 ELSE 0 END) AS pud,
         max(CASE WHEN {SQL_CONDO} THEN 1 ELSE 0 END) AS condo,
         sum(CASE WHEN o_orderstatus IN ('F','O') THEN 1 ELSE 0 END) AS mortgage
  FROM orders GROUP BY o_custkey),
parcels AS (
  SELECT c_custkey AS RowID, c_nationkey AS county, c_mktsegment AS subdivision, c_acctbal AS value,
         CAST(1940 + c_custkey % 76 AS BIGINT) AS YearBuilt,
         CASE WHEN mortgage > 0 THEN greatest(pud, condo) END AS hoa,
         CAST(mortgage AS BIGINT) AS mortgage
  FROM customer JOIN status ON c_custkey = k)"""


def status_table(spark: SparkSession, sf: str) -> DataFrame:
    from plotmark.operators.records import ever_flag

    return ever_flag(
        table(spark, sf, "orders"), "o_custkey", {"pud": pud(), "condo": condo()}, observed(), "hoa", "mortgage"
    )


def parcels(spark: SparkSession, sf: str) -> DataFrame:
    status = status_table(spark, sf).select(F.col("o_custkey").alias("RowID"), "hoa", "mortgage")
    homes = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("RowID"),
        F.col("c_nationkey").alias("county"),
        F.col("c_mktsegment").alias("subdivision"),
        F.col("c_acctbal").alias("value"),
        (1940 + F.col("c_custkey") % 76).alias("YearBuilt"),
    )
    return homes.join(status, "RowID")


def regression_rows(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return (
        table(spark, sf, "lineitem")
        .select("l_suppkey", "l_extendedprice", "l_returnflag", "l_tax", "l_quantity", "l_discount", "l_linestatus")
        .join(supplier, "l_suppkey")
        .withColumns(
            {
                "y": F.log1p("l_extendedprice"),
                "x1": (F.col("l_returnflag") == "R").cast("int"),
                "x2": F.log1p(F.col("l_tax") * 100),
            }
        )
    )


SQL_ROWS = """
d AS (
  SELECT l_suppkey, s_nationkey, l_linestatus, l_returnflag, l_quantity, l_discount, l_extendedprice,
         ln(l_extendedprice + 1) AS y, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS x1,
         ln(l_tax * 100 + 1) AS x2
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
