"""Status, first records, group filters and modes."""

from pyspark.sql import functions as F

from checks.roles import SQL_CONDO, SQL_PUD, SQL_STATUS, condo, parcels, pud, query, r6, status_table, table
from plotmark.functions.scalars import age_at, day_number, log_plus_one, month_index, not_in, present, top_code
from plotmark.functions.status import cutoff_status, fuse_status
from plotmark.operators import areas, records
from plotmark.operators.skew import with_group_values
from plotmark.operators.summaries import attrition
from plotmark.sources.contracts import semi_scan
from plotmark.sources.sinks import anti_ledger

LO, HI = 0.5, 0.65
BINS = "CASE WHEN {0} >= 0.65 THEN 1 WHEN {0} >= 0.5 THEN 9 WHEN {0} >= 0 THEN 0 ELSE 10 END"


@query(f"WITH {SQL_STATUS} SELECT k AS o_custkey, pud, condo, CAST(mortgage AS BIGINT) AS mortgage, "
       "CASE WHEN mortgage > 0 THEN greatest(pud, condo) END AS hoa FROM status")
def ever_flag(spark, sf):
    return status_table(spark, sf)


@query(f"SELECT o_custkey, CAST(sum(CASE WHEN {SQL_PUD} THEN 1 ELSE 0 END) AS BIGINT) AS pud, "
       f"CAST(sum(CASE WHEN {SQL_CONDO} THEN 1 ELSE 0 END) AS BIGINT) AS condo FROM orders GROUP BY 1")
def flag_counts(spark, sf):
    return records.flag_counts(table(spark, sf, "orders"), "o_custkey", {"pud": pud(), "condo": condo()})


@query(f"""WITH {SQL_STATUS},
 n AS (SELECT county, avg(hoa) AS rate, count(hoa) AS n FROM parcels GROUP BY 1)
 SELECT p.county, n_regionkey AS region, count(*) AS parcels, count(p.hoa) AS observed, round(avg(p.hoa), 6) AS rate
 FROM parcels p JOIN n USING (county) JOIN nation ON n_nationkey = p.county GROUP BY 1, 2""")
def parcel_status(spark, sf):
    """Flagged share per area after the coverage rule: the flagship query."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("county"), F.col("n_regionkey").alias("region"))
    placed = parcels(spark, sf).join(nation, "county")
    kept = areas.coverage_filter(placed, "hoa", "county", "region", 40)
    return kept.groupBy("county", "region").agg(
        F.count("*").alias("parcels"), F.count("hoa").alias("observed"), r6(F.avg("hoa")).alias("rate")
    )


@query(f"""WITH s AS (
   SELECT o_custkey AS k, max(CASE WHEN {SQL_PUD} AND o_totalprice > 490000 THEN 1 ELSE 0 END) AS hoa
   FROM orders GROUP BY 1),
 p AS (SELECT c_nationkey AS county, n_regionkey AS region, hoa
       FROM customer JOIN s ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey),
 a AS (SELECT county, avg(hoa) AS rate, count(hoa) AS n FROM p GROUP BY 1),
 g AS (SELECT region, avg(hoa) AS rate FROM p GROUP BY 1)
 SELECT p.county, p.region, count(*) AS n, round(avg(p.hoa), 6) AS rate
 FROM p JOIN a USING (county) JOIN g ON g.region = p.region
 WHERE NOT (g.rate = 0 OR (a.rate = 0 AND a.n >= 60)) GROUP BY 1, 2""")
def area_rate_coverage(spark, sf):
    seen = records.ever_flag(
        table(spark, sf, "orders"), "o_custkey", {"rider": pud() & (F.col("o_totalprice") > 490000)}, F.lit(True), "hoa"
    )
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("county"), F.col("n_regionkey").alias("region"))
    homes = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("county"))
    placed = homes.join(seen.select("o_custkey", "hoa"), "o_custkey").join(nation, "county")
    kept = areas.coverage_filter(placed, "hoa", "county", "region", 60)
    return kept.groupBy("county", "region").agg(F.count("*").alias("n"), r6(F.avg("hoa")).alias("rate"))


@query(f"""WITH {SQL_STATUS},
 g AS (SELECT county, subdivision, count(*) AS n, avg(hoa) AS share FROM parcels GROUP BY 1, 2)
 SELECT RowID, round(CASE WHEN n >= 10 THEN share END, 6) AS share,
   {BINS.format("(CASE WHEN n >= 10 THEN share END)")} AS status
 FROM parcels JOIN g USING (county, subdivision)""")
def cutoff_status_by_group(spark, sf):
    df = areas.group_share(parcels(spark, sf), ["county", "subdivision"], "hoa", "share", 10)
    return df.select("RowID", r6("share").alias("share"), cutoff_status("share", LO, HI).alias("status"))


@query(f"""WITH {SQL_STATUS},
 s AS (SELECT county, subdivision, avg(hoa) AS share FROM parcels GROUP BY 1, 2),
 c AS (SELECT RowID % 40 AS cell, avg(hoa) AS share FROM parcels GROUP BY 1),
 x AS (SELECT RowID, {BINS.format("c.share")} AS a, {BINS.format("s.share")} AS b
       FROM parcels p JOIN s USING (county, subdivision) JOIN c ON c.cell = p.RowID % 40)
 SELECT a, b, CASE WHEN (a = 1 AND b <> 0) OR (b = 1 AND a <> 0) THEN 1
                   WHEN (a = 0 AND b <> 1) OR (b = 0 AND a <> 1) THEN 0 ELSE 9 END AS fused, count(*) AS n
 FROM x GROUP BY 1, 2, 3""")
def fuse_two_statuses(spark, sf):
    df = parcels(spark, sf).withColumn("cell", F.col("RowID") % 40)
    df = areas.group_share(df, ["county", "subdivision"], "hoa", "sub", 1)
    df = areas.group_share(df, ["cell"], "hoa", "clu", 1)
    df = df.select(cutoff_status("clu", LO, HI).alias("a"), cutoff_status("sub", LO, HI).alias("b"))
    return df.withColumn("fused", fuse_status("a", "b")).groupBy("a", "b", "fused").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_STATUS}, c AS (SELECT county, YearBuilt, count(*) AS n FROM parcels GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY n DESC, YearBuilt) AS i, sum(n) OVER (PARTITION BY county) AS t FROM c)
 SELECT county, YearBuilt AS mode, CAST(t AS BIGINT) AS group_n FROM r WHERE i = 1""")
def modal_year(spark, sf):
    return areas.group_mode(parcels(spark, sf), ["county"], "YearBuilt")


@query(f"""WITH {SQL_STATUS}, c AS (SELECT county, YearBuilt, count(*) AS n FROM parcels GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY n DESC, YearBuilt) AS i FROM c)
 SELECT RowID, p.county, p.YearBuilt FROM parcels p JOIN r ON r.county = p.county AND i = 1
 WHERE abs(p.YearBuilt - r.YearBuilt) <= 5""")
def near_modal_year(spark, sf):
    return areas.near_mode(parcels(spark, sf), ["county"], "YearBuilt", 5).select("RowID", "county", "YearBuilt")


FIRST = """row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_extendedprice, l_discount, l_returnflag)"""
ITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


@query(f"""SELECT {', '.join(ITEM)} FROM (SELECT *, {FIRST} AS i FROM lineitem) WHERE i = 1""")
def first_child(spark, sf):
    return records.first_per_key(table(spark, sf, "lineitem").select(*ITEM), "l_orderkey", ["l_linenumber"])


@query("""WITH x AS (SELECT l_partkey, l_linenumber, nullif(l_tax, 0.0) AS tax FROM lineitem)
 SELECT l_partkey, tax, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, tax) AS i
 FROM x WHERE tax IS NOT NULL) WHERE i = 1""")
def first_non_null(spark, sf):
    items = table(spark, sf, "lineitem").select("l_partkey", F.nullif("l_tax", F.lit(0.0)).alias("tax"), "l_linenumber")
    return records.first_per_key(items, "l_partkey", ["l_linenumber"], not_null="tax")


@query("""SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned,
 max(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS discounted FROM lineitem GROUP BY 1""")
def child_any(spark, sf):
    flags = {"returned": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") >= 0.09}
    return records.child_flag(table(spark, sf, "lineitem"), "l_orderkey", flags)


@query(f"""SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned
 FROM (SELECT *, {FIRST} AS i FROM lineitem) WHERE i = 1""")
def child_first(spark, sf):
    items = table(spark, sf, "lineitem").select(*ITEM)
    return records.child_flag(items, "l_orderkey", {"returned": F.col("l_returnflag") == "R"}, "first", ["l_linenumber"])


@query("SELECT l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def max_child(spark, sf):
    return records.largest_per_key(
        table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice", F.col("l_linestatus") == "F"
    )


@query("""WITH b AS (SELECT l_partkey, max(l_extendedprice) AS top FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
 a AS (SELECT l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem WHERE l_quantity > 45 GROUP BY 1),
 q AS (SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem WHERE l_tax > 0.06 GROUP BY 1),
 s AS (SELECT l_partkey, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS supplier FROM lineitem WHERE l_discount > 0.08 GROUP BY 1)
 SELECT p_partkey, p_size, coalesce(top, 0) AS top, coalesce(returned, 0) AS returned, round(coalesce(quantity, 0), 6) AS quantity, supplier
 FROM part LEFT JOIN b ON b.l_partkey = p_partkey LEFT JOIN a ON a.l_partkey = p_partkey
 LEFT JOIN q ON q.l_partkey = p_partkey LEFT JOIN s ON s.l_partkey = p_partkey""")
def wide_assembly(spark, sf):
    items, key = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey"
    children = [
        records.largest_per_key(items, key, "l_extendedprice", F.col("l_linestatus") == "F").withColumnRenamed("l_extendedprice", "top"),
        records.child_flag(items.filter("l_quantity > 45"), key, {"returned": F.col("l_returnflag") == "R"}),
        items.filter("l_tax > 0.06").groupBy(key).agg(r6(F.sum("l_quantity")).alias("quantity")),
        records.first_per_key(
            items.filter("l_discount > 0.08").select(key, "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("supplier")),
            key, ["l_orderkey", "l_linenumber"],
        ).select(key, "supplier"),
    ]
    parent = table(spark, sf, "part").select(key, "p_size")
    return records.assemble(parent, children, key, {"top": 0.0, "returned": 0, "quantity": 0.0})


@query("""SELECT c_custkey, c_nationkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000) AS has_large FROM customer""")
def semi_anti(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    large = table(spark, sf, "orders").filter("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"))
    found = semi_scan(customer, "c_custkey", large).withColumn("has_large", F.lit(True))
    rest = anti_ledger(customer, large, key="c_custkey").withColumn("has_large", F.lit(False))
    return found.unionByName(rest)


@query("""SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 20000) AND c_nationkey NOT IN (3, 4)""")
def work_list_minus_ledgers(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    done, failed = orders.filter("o_orderstatus = 'P'"), orders.filter("o_totalprice < 20000")
    work = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return anti_ledger(work, done, failed, key="c_custkey", skip=[3, 4], skip_column="c_nationkey")


@query("""WITH x AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS code, o_totalprice AS price,
   CAST(o_orderdate AS DATE) AS day, CAST(1940 + o_custkey % 76 AS BIGINT) AS built FROM orders)
 SELECT o_orderkey, round(ln(price + 1), 6) AS lprice, CAST(date_diff('day', DATE '1960-01-01', day) AS INTEGER) AS day_no,
   CASE WHEN year(day) - built >= 0 THEN year(day) - built END AS age, CAST((year(day) - 1960) * 12 + month(day) - 1 AS INTEGER) AS month_no,
   CASE WHEN price >= 300000 THEN 300000.0 ELSE price END AS capped, CASE WHEN code IS NULL THEN 0 ELSE 1 END AS coded
 FROM x WHERE price BETWEEN 1000 AND 400000 AND (code IS NULL OR code NOT IN ('2-HIGH', '3-MEDIUM'))""")
def clean_sales(spark, sf):
    day = F.to_date("o_orderdate")
    df = table(spark, sf, "orders").withColumn("code", F.nullif("o_orderpriority", F.lit("5-LOW")))
    df = df.filter(F.col("o_totalprice").between(1000, 400000) & not_in("code", ["2-HIGH", "3-MEDIUM"]))
    return df.select(
        "o_orderkey",
        r6(log_plus_one("o_totalprice")).alias("lprice"),
        day_number(day).alias("day_no"),
        age_at(F.year(day), 1940 + F.col("o_custkey") % 76).alias("age"),
        month_index(day).alias("month_no"),
        top_code("o_totalprice", 300000.0).alias("capped"),
        present("code").alias("coded"),
    )


@query(f"""WITH {SQL_STATUS}, g AS (SELECT county FROM parcels GROUP BY 1 HAVING count(*) >= 55 AND avg(hoa) >= 0.55)
 SELECT RowID, county FROM parcels WHERE county IN (SELECT county FROM g)""")
def support_filter(spark, sf):
    df = areas.support_filter(parcels(spark, sf), "county", 55, rate="hoa", min_rate=0.55)
    return df.select("RowID", "county")


@query(f"""WITH {SQL_STATUS} SELECT county, count(*) AS size, count(hoa) AS n, round(avg(hoa), 6) AS rate FROM parcels
 GROUP BY 1 HAVING count(hoa) >= 60 AND avg(hoa) >= 0.55""")
def qualify_groups(spark, sf):
    found = areas.qualified_groups(parcels(spark, sf), ["county"], 60, "hoa", "hoa", 0.55)
    return found.select("county", F.col("_size").alias("size"), F.col("_n").alias("n"), r6("_rate").alias("rate"))


@query(f"""WITH {SQL_STATUS} SELECT RowID, CASE WHEN subdivision <> 'MACHINERY' THEN count(*) OVER (PARTITION BY county, subdivision) END AS size FROM parcels""")
def group_size(spark, sf):
    df = areas.group_size(parcels(spark, sf), ["county", "subdivision"], "size", no_name=["MACHINERY"])
    return df.select("RowID", "size")


@query(f"""WITH {SQL_STATUS}, k AS (SELECT *, nullif(subdivision, 'BUILDING') AS s FROM parcels)
 SELECT RowID, CASE WHEN s IS NOT NULL THEN round(avg(value) OVER (PARTITION BY s), 4) END AS mean_value,
  CASE WHEN s IS NOT NULL THEN count(hoa) OVER (PARTITION BY s) END AS n FROM k""")
def group_values_on_rows(spark, sf):
    df = parcels(spark, sf).withColumn("s", F.nullif("subdivision", F.lit("BUILDING")))
    df = with_group_values(df, ["s"], mean_value=F.avg("value"), n=F.count("hoa"))
    return df.select("RowID", r6("mean_value", 4).alias("mean_value"), "n")


@query("""WITH x AS (SELECT l_suppkey, CASE WHEN l_suppkey % 7 = 0 THEN 'A' ELSE l_returnflag END AS f, l_linenumber AS ln,
   CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem)
 SELECT l_suppkey, concat_ws(',', CASE WHEN count(DISTINCT f) > 1 THEN 'f' END, CASE WHEN count(DISTINCT ln) > 1 THEN 'ln' END,
   CASE WHEN count(DISTINCT tax) > 1 THEN 'tax' END) AS usable FROM x GROUP BY 1""")
def usable_columns(spark, sf):
    s = F.col("l_suppkey")
    df = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.when(s % 7 == 0, "A").otherwise(F.col("l_returnflag")).alias("f"),
        F.col("l_linenumber").alias("ln"),
        F.when(s % 5 != 0, F.col("l_tax")).alias("tax"),
    )
    found = areas.usable_columns(df, "l_suppkey", ["f", "ln", "tax"])
    return found.select("l_suppkey", F.concat_ws(",", "usable").alias("usable"))


@query(f"""WITH {SQL_STATUS}, p AS (SELECT subdivision, county, n_regionkey AS region, hoa, YearBuilt, value FROM parcels JOIN nation ON n_nationkey = county),
 g AS (SELECT grouping_id(subdivision, county, region) AS gid, subdivision, county, region, avg(hoa) AS rate,
   avg(CASE WHEN YearBuilt BETWEEN 2000 AND 2015 THEN hoa END) AS rate_new
   FROM p GROUP BY GROUPING SETS ((subdivision), (county), (region)))
 SELECT CASE gid WHEN 3 THEN 'subdivision' WHEN 5 THEN 'county' ELSE 'region' END AS level,
   coalesce(subdivision, CAST(county AS VARCHAR), CAST(region AS VARCHAR)) AS area, round(rate, 6) AS rate, round(rate_new, 6) AS rate_new FROM g""")
def rates_multi(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("county"), F.col("n_regionkey").alias("region"))
    df = parcels(spark, sf).join(nation, "county")
    new = F.when(F.col("YearBuilt").between(2000, 2015), F.col("hoa"))
    rates = areas.area_rates(df, ["subdivision", "county", "region"], {"rate": F.col("hoa"), "rate_new": new})
    return rates.select("level", "area", r6("rate").alias("rate"), r6("rate_new").alias("rate_new"))


@query(f"""WITH {SQL_STATUS} SELECT hoa, count(*) AS all_rows, count(*) FILTER (YearBuilt >= 1960) AS built_1960,
 count(*) FILTER (YearBuilt >= 1960 AND mortgage >= 5) AS traded FROM parcels GROUP BY 1""")
def attrition_stages(spark, sf):
    built = F.col("YearBuilt") >= 1960
    return attrition(parcels(spark, sf), "hoa", {"built_1960": built, "traded": built & (F.col("mortgage") >= 5)})


@query(f"""SELECT o_orderstatus, CAST(count(*) FILTER ({SQL_PUD}) AS BIGINT) AS pud, CAST(count(*) FILTER (o_totalprice > 300000) AS BIGINT) AS large FROM orders GROUP BY 1""")
def count_if(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count_if(pud()).alias("pud"), F.count_if(F.col("o_totalprice") > 300000).alias("large")
    )
