"""Text and columnar sources and sinks, through round trips of the supplied tables."""

from pyspark.sql import functions as F, types as T

from checks.roles import query, r6, table
from plotmark.session import scratch_path
from plotmark.sources import layout, sinks
from plotmark.sources.contracts import semi_scan


def _layout_of(spark, df, name: str):
    """Column dictionary rows of a table, as a layout file would list them."""
    kinds = {"bigint": "int64", "int": "int64", "double": "float64"}
    rows = [(name, i, f.name, kinds.get(f.dataType.simpleString(), "str")) for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, position int, field_name string, data_type string")


@query("""SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_name || ' "é' AS label FROM customer""")
def headerless_text(spark, sf):
    """Pipe-delimited ISO-8859-1 text without quoting, read by layout and ordinals."""
    df = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(' "é')).alias("label"), "c_acctbal", "c_nationkey")
    path = scratch_path(spark, "headerless")
    df.write.option("sep", "|").option("quote", "").option("escape", "").option("encoding", "ISO-8859-1").csv(path)
    schema = layout.schema_from_layout(_layout_of(spark, df, "utMain"), "utMain")
    columns = layout.pick_ordinals(schema, [0, 1, 3])
    return layout.read_delimited(spark, path, schema, columns=columns)


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)""")
def filtered_text_scan(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    path = scratch_path(spark, "filtered")
    df.write.option("sep", "|").csv(path)
    schema = layout.schema_from_layout(_layout_of(spark, df, "utItem"), "utItem")
    scan = layout.read_delimited(spark, path, schema, columns=["l_orderkey", "l_linenumber", "l_quantity"])
    wanted = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"))
    return semi_scan(scan, "l_orderkey", wanted)


@query("""SELECT c_nationkey, count(*) AS records, count(*) FILTER (c_custkey % 7 = 0 OR c_custkey % 11 = 0) AS rejected,
 CAST(sum(CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 0 ELSE c_custkey END) AS BIGINT) AS good,
 CAST(sum(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey * 2 END) AS BIGINT) AS amount FROM customer GROUP BY 1""")
def rejected_records(spark, sf):
    """Records with a surplus field or text in place of a number are told apart from good ones."""
    k = F.col("c_custkey")
    amount = F.when(k % 7 == 0, "x").otherwise((k * 2).cast("string"))
    line = F.concat_ws("|", k, "c_nationkey", amount, F.when(k % 11 == 0, "surplus"))
    path = scratch_path(spark, "rejects")
    table(spark, sf, "customer").select(line).write.text(path)
    schema = T.StructType.fromDDL("c_custkey bigint, c_nationkey int, amount bigint")
    df = layout.read_delimited(spark, path, schema, reject_column="bad")
    good = F.when(F.col("bad").isNull(), F.col("c_custkey")).otherwise(0)
    return df.groupBy("c_nationkey").agg(F.count("*").alias("records"), F.count("bad").alias("rejected"), F.sum(good).alias("good"), F.sum("amount").alias("amount"))


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, n_name FROM nation")
def csv_with_header(spark, sf):
    """Codes with leading zeros stay text; only the wanted columns are parsed."""
    path = scratch_path(spark, "header")
    nation = table(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"), "n_name", "n_regionkey")
    sinks.write_csv(nation, path)
    schema = T.StructType.fromDDL("code string, n_name string, n_regionkey int")
    return layout.read_delimited(spark, path, schema, columns=["code", "n_name"], sep=",", header=True, encoding="UTF-8", quote='"')


@query("SELECT regtype, o_orderstatus AS cbsacode, round(avg(o_totalprice), 4) AS coef FROM (SELECT 'ols' AS regtype, * FROM orders) GROUP BY 1, 2")
def csv_without_header(spark, sf):
    path = scratch_path(spark, "plain")
    found = table(spark, sf, "orders").groupBy("o_orderstatus").agg(r6(F.avg("o_totalprice"), 4).alias("coef"))
    sinks.write_csv(found.select(F.lit("ols"), "o_orderstatus", "coef"), path, header=False)
    schema = T.StructType.fromDDL("regtype string, cbsacode string, coef double")
    return layout.read_delimited(spark, path, schema, sep=",", encoding="UTF-8")


@query("SELECT o_orderstatus, count(*) AS n, true AS named FROM orders GROUP BY 1")
def union_of_csv_files(spark, sf):
    """Many files with one header, each row with the file it came from."""
    path = scratch_path(spark, "listings")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    orders.write.option("header", True).partitionBy("o_orderstatus").csv(path)
    schema = T.StructType.fromDDL("o_orderkey bigint, o_totalprice double")
    out = None
    for status in ("F", "O", "P"):
        part = layout.union_csv(spark, f"{path}/o_orderstatus={status}/*.csv", schema).withColumn("o_orderstatus", F.lit(status))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("o_orderstatus").agg(
        F.count("o_orderkey").alias("n"), F.bool_and(F.col("source_file").endswith(".csv")).alias("named")
    )


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2")
def partitioned_table(spark, sf):
    """One folder per key from one job, read back with its partition column."""
    path = scratch_path(spark, "by_nation")
    sinks.write_partitioned(table(spark, sf, "customer"), path, ["c_nationkey"])
    return spark.read.parquet(path).groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT 'mean' AS regtype, o_orderstatus AS "group", round(avg(o_totalprice), 4) AS coef, count(*) AS n FROM orders GROUP BY 2
 UNION ALL SELECT 'max', o_orderpriority, max(o_totalprice), count(*) FROM orders GROUP BY 2""")
def appended_results(spark, sf):
    path = scratch_path(spark, "results")
    orders = table(spark, sf, "orders")
    for regtype, key, stat in (("mean", "o_orderstatus", r6(F.avg("o_totalprice"), 4)), ("max", "o_orderpriority", F.max("o_totalprice"))):
        rows = orders.groupBy(F.col(key).alias("group")).agg(stat.alias("coef"), F.count("*").alias("n"))
        sinks.append_results(rows.withColumn("regtype", F.lit(regtype)), path)
    return spark.read.parquet(path).filter("written_at is not null").select("regtype", "group", "coef", "n")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('P'))")
def ledger_round_trip(spark, sf):
    """Finished and failed items are appended to a ledger; the next run skips them."""
    path = scratch_path(spark, "ledger")
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey").filter("o_orderstatus = 'P'")
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"):
        sinks.append_ledger(orders.filter(part).select("c_custkey").distinct(), path)
    return sinks.anti_ledger(table(spark, sf, "customer").select("c_custkey"), spark.read.parquet(path), key="c_custkey")


@query("SELECT p_type, count(*) AS n, count(CASE WHEN p_size % 10 > 0 THEN 1 END) AS known, round(avg(CASE WHEN p_size % 10 > 0 THEN p_retailprice END), 4) AS mean FROM part GROUP BY 1")
def saved_table_with_missing(spark, sf):
    """NaN from another system is missing, so aggregates skip it."""
    path = scratch_path(spark, "saved")
    price = F.when(F.col("p_size") % 10 > 0, F.col("p_retailprice")).otherwise(F.lit(float("nan")))
    sinks.write_table(table(spark, sf, "part").select("p_type", price.alias("price"), "p_size"), path)
    df = layout.read_table(spark, path, ["p_type", "price"])
    return df.groupBy("p_type").agg(F.count("*").alias("n"), F.count("price").alias("known"), r6(F.avg("price"), 4).alias("mean"))


@query("""SELECT 'orders' AS run, o_orderstatus AS "group", round(avg(o_totalprice), 4) AS coef, count(*) AS n FROM orders GROUP BY 2
 UNION ALL SELECT 'lines', l_linestatus, round(avg(l_extendedprice), 4), count(*) FROM lineitem GROUP BY 2""")
def repeated_runs(spark, sf):
    """Results appended by two runs, of which one is repeated and replaces its own rows, and one failed before it published."""
    path = scratch_path(spark, "runs")

    def rows(name, key, value):
        return table(spark, sf, name).groupBy(F.col(key).alias("group")).agg(r6(F.avg(value), 4).alias("coef"), F.count("*").alias("n"))

    orders, lines = rows("orders", "o_orderstatus", "o_totalprice"), rows("lineitem", "l_linestatus", "l_extendedprice")
    sinks.publish_run(orders.withColumn("coef", F.lit(0.0)), path, "orders", stamp=True)
    sinks.publish_run(lines, path, "lines", stamp=True)
    lines.write.parquet(f"{path}/attempt-{'0' * 32}")
    sinks.publish_run(orders, path, "orders", stamp=True)
    return sinks.read_runs(spark, path).filter("written_at is not null").select("run", "group", "coef", "n")
