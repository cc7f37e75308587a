"""Summary tables, scalar functions, joins, set operations and samples."""

from pyspark.sql import functions as F

from checks.roles import SQL_STATUS, parcels, query, r6, table
from plotmark.functions import scalars as S
from plotmark.models.screening import correlation
from plotmark.operators.numbering import group_number
from plotmark.operators import sampling, summaries
from plotmark.operators.areas import group_means
from plotmark.sources.contracts import assert_unique, lookup
from plotmark.sources.layout import cast_columns


@query("""SELECT c_nationkey, round(median(o_totalprice), 4) AS median, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
 GROUP BY 1 HAVING count(*) >= 500""")
def median_fee(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    priced = table(spark, sf, "orders").select("o_custkey", "o_totalprice").join(customer, "o_custkey")
    medians = summaries.group_median(priced, ["c_nationkey"], "o_totalprice")
    return medians.filter("n >= 500").select("c_nationkey", r6("median", 4).alias("median"), "n")


@query("""SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd,
 min(o_totalprice) AS min, max(o_totalprice) AS max,
 round(quantile_cont(o_totalprice, 0.01), 4) AS p01, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
 round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.99), 4) AS p99,
 round((avg(o_totalprice ** 3) - 3 * avg(o_totalprice) * avg(o_totalprice ** 2) + 2 * avg(o_totalprice) ** 3) / var_pop(o_totalprice) ** 1.5, 4) AS skewness
 FROM orders GROUP BY 1""")
def distribution(spark, sf):
    found = summaries.distribution(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"], (0.01, 0.25, 0.5, 0.99))
    shown = ["mean", "sd", "p01", "p25", "p50", "p99", "skewness"]
    return found.select("o_orderstatus", "n", "min", "max", *[r6(c, 4).alias(c) for c in shown])


@query("""SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
 round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem""")
def distribution_overall(spark, sf):
    found = summaries.distribution(table(spark, sf, "lineitem"), "l_extendedprice", (), (0.1, 0.9))
    return found.select("n", *[r6(c, 4).alias(c) for c in ("mean", "p10", "p90")])


@query("""WITH w AS (SELECT o_custkey AS k, count(*) AS w FROM orders GROUP BY 1),
 x AS (SELECT c_mktsegment, w, c_acctbal AS bal, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal / 2 END AS part FROM customer JOIN w ON k = c_custkey)
 SELECT c_mktsegment, round(sum(w * bal) / sum(w), 4) AS bal, round(sum(w * part) / sum(w) FILTER (part IS NOT NULL), 4) AS part FROM x GROUP BY 1""")
def weighted_profile(spark, sf):
    w = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("w"))
    df = table(spark, sf, "customer").join(w, "c_custkey").select(
        "c_mktsegment", "w", F.col("c_acctbal").alias("bal"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal") / 2).alias("part"),
    )
    means = summaries.weighted_mean(df, ["bal", "part"], "w", ["c_mktsegment"])
    return means.select("c_mktsegment", r6("bal", 4).alias("bal"), r6("part", 4).alias("part"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""WITH {SQL_STATUS}, c AS (SELECT county, subdivision AS g, count(*) AS n FROM parcels GROUP BY 1, 2),
 a AS (SELECT county, avg(hoa) AS f, count(*) AS t FROM parcels GROUP BY 1),
 w AS (SELECT county, f AS wt, 'hoa' AS weight FROM a UNION ALL SELECT county, 1 - f, 'nonhoa' FROM a)
 SELECT i.g AS group_i, w.weight, j.g AS group_j, round(sum(i.n * w.wt * coalesce(j2.n, 0) / a.t) / sum(i.n * w.wt), 6) AS exposure
 FROM c i JOIN a USING (county) JOIN w USING (county) CROSS JOIN (SELECT DISTINCT g FROM c) j
 LEFT JOIN c j2 ON j2.county = i.county AND j2.g = j.g GROUP BY 1, 2, 3""")
def exposure_matrix(spark, sf):
    names = {s: s.lower() for s in SEGMENTS}
    counties = parcels(spark, sf).groupBy("county").agg(
        F.avg("hoa").alias("f"), F.count("*").alias("t"),
        *[F.count_if(F.col("subdivision") == s).alias(n) for s, n in names.items()],
    )
    counties = counties.withColumns({f"{n}_share": F.col(n) / F.col("t") for n in names.values()})
    found = summaries.exposure_matrix(
        counties, names, {s: f"{n}_share" for s, n in names.items()}, {"hoa": F.col("f"), "nonhoa": 1 - F.col("f")}
    )
    return found.withColumn("exposure", r6("exposure"))


@query(f"""WITH {SQL_STATUS} SELECT 'hoa' AS grouping, CAST(hoa AS VARCHAR) AS value, count(*) AS n, round(avg(value), 4) AS value_mean, round(avg(YearBuilt), 4) AS built
 FROM parcels WHERE hoa IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'segment', subdivision, count(*), round(avg(value), 4), round(avg(YearBuilt), 4) FROM parcels GROUP BY 2
 UNION ALL SELECT 'segment since 1960', subdivision, count(*), round(avg(value), 4), round(avg(YearBuilt), 4) FROM parcels WHERE YearBuilt >= 1960 GROUP BY 2""")
def group_summary(spark, sf):
    df = parcels(spark, sf).select("hoa", "subdivision", F.col("value").alias("balance"), F.col("YearBuilt").alias("built"))
    found = summaries.stacked_means(
        df,
        ["balance", "built"],
        [("hoa", "hoa", None), ("segment", "subdivision", None), ("segment since 1960", "subdivision", F.col("built") >= 1960)],
    )
    return found.select("grouping", "value", "n", r6("balance", 4).alias("value_mean"), r6("built", 4).alias("built"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "o_orderstatus_F", count(*) FILTER (o_orderstatus = 'O') AS "o_orderstatus_O",
 count(*) FILTER (o_orderstatus = 'P') AS "o_orderstatus_P" FROM orders GROUP BY 1""")
def crosstab(spark, sf):
    return summaries.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 10 GROUP BY 1")
def value_counts(spark, sf):
    return summaries.value_counts(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_quantity") >= 10)


@query("""WITH r AS (SELECT l_suppkey, l_partkey, avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey) AS rate FROM lineitem)
 SELECT 'l_suppkey' AS key, 'any' AS condition, count(DISTINCT l_suppkey) AS n FROM r
 UNION ALL SELECT 'l_suppkey', 'above', count(DISTINCT l_suppkey) FROM r WHERE rate > 0.33
 UNION ALL SELECT 'l_partkey', 'any', count(DISTINCT l_partkey) FROM r
 UNION ALL SELECT 'l_partkey', 'above', count(DISTINCT l_partkey) FROM r WHERE rate > 0.33""")
def distinct_if(spark, sf):
    from plotmark.operators.skew import with_group_values

    items = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    rated = with_group_values(items, ["l_suppkey"], rate=F.avg(S.flag(F.col("l_returnflag") == "R")))
    return summaries.distinct_if(rated, ["l_suppkey", "l_partkey"], {"any": F.lit(True), "above": F.col("rate") > 0.33})


@query("""SELECT c_nationkey, count(*) FILTER (c_acctbal > 5000) AS flagged, count(*) AS total,
 round(count(*) FILTER (c_acctbal > 5000) / count(*), 6) AS share FROM customer GROUP BY 1""")
def share_within(spark, sf):
    found = summaries.share_within(table(spark, sf, "customer"), "c_nationkey", F.col("c_acctbal") > 5000)
    return found.withColumn("share", r6("share"))


# Of many degrees of freedom, a t beyond these has a p-value below the level.
LEVELS = {0.5: 0.6745, 0.1: 1.6451, 0.05: 1.9603}


def sql_correlation(a: str, b: str) -> str:
    below = " + ".join(f"CAST(abs(r) * sqrt((n - 2) / (1 - r * r)) > {t} AS INTEGER)" for t in LEVELS.values())
    return f"""SELECT '{b}' AS other, l_returnflag, n, round(r, 6) AS r, {below} AS levels_passed
      FROM (SELECT l_returnflag, count(*) AS n, corr({a}, {b}) AS r FROM lineitem GROUP BY 1)"""


@query(f"{sql_correlation('l_quantity', 'l_extendedprice')} UNION ALL {sql_correlation('l_quantity', 'l_tax')}")
def pairwise_correlation(spark, sf):
    """Correlations, and how many of the usual levels their p-values are below."""
    out = None
    for b in ("l_extendedprice", "l_tax"):
        found = correlation(table(spark, sf, "lineitem"), "l_quantity", b, ["l_returnflag"])
        passed = sum((F.col("p") < level).cast("int") for level in LEVELS)
        shown = found.select(F.lit(b).alias("other"), "l_returnflag", "n", r6("r").alias("r"), passed.alias("levels_passed"))
        out = shown if out is None else out.unionByName(shown)
    return out


@query("""SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS z_p_size,
 round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS z_p_retailprice FROM part""")
def standardise(spark, sf):
    found = summaries.standardise(table(spark, sf, "part"), ["p_size", "p_retailprice"])
    return found.select("p_partkey", r6("z_p_size").alias("z_p_size"), r6("z_p_retailprice").alias("z_p_retailprice"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS economy, p_size * CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS economy_x_p_size,
 (SELECT count(DISTINCT p_type) FROM part) AS levels FROM part""")
def dummies_and_interactions(spark, sf):
    part = table(spark, sf, "part")
    levels = summaries.levels_of(part, "p_type")
    df = summaries.one_hot(part, "p_type", levels)
    df = df.withColumn("economy", F.col(f"p_type_{levels.index('ECONOMY') + 1}"))
    df = summaries.interact(df, "economy", ["p_size"])
    return df.select("p_partkey", "economy", "economy_x_p_size", F.lit(len(levels)).cast("long").alias("levels"))


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1, 2""")
def group_means_by(spark, sf):
    found = group_means(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_tax"])
    return found.select("l_returnflag", "l_linestatus", r6("l_quantity").alias("l_quantity"), r6("l_tax").alias("l_tax"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, dense_rank() OVER (ORDER BY l_suppkey, l_linenumber) AS group_id FROM lineitem""")
def group_identifier(spark, sf):
    """Dense number of each row's key pair."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return group_number(df, ["l_suppkey", "l_linenumber"])


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey < 100000 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE CAST(c_custkey AS VARCHAR) END AS fips,
   lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR), 15, '0') AS block FROM customer)
 SELECT c_custkey, fips, 'G' || fips[1:2] || '0' || fips[3:] || '0' AS county, 'G' || fips[1:2] AS state,
   block[1:9] || block[11:13] AS blockgroup, block[1:9] AS tract FROM x""")
def geography_keys(spark, sf):
    fips = S.zero_pad("c_custkey", 5)
    block = S.zero_pad(F.col("c_custkey") * 7919 % 10000000000, 15)
    return table(spark, sf, "customer").select(
        "c_custkey", fips.alias("fips"), S.gisjoin_county(fips).alias("county"), S.gisjoin_state(fips).alias("state"),
        S.blockgroup_id(block).alias("blockgroup"), F.substring(block, 1, 9).alias("tract"),
    )


@query("""WITH x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '-6789'
   WHEN 2 THEN CAST(c_custkey AS VARCHAR) || '.0' ELSE '99' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS zip FROM customer)
 SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN '99' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS zip FROM x""")
def clean_zip(spark, sf):
    k = F.col("c_custkey").cast("string")
    padded = F.lpad(k, 5, "0")
    raw = (
        F.when(F.col("c_custkey") % 4 == 0, k)
        .when(F.col("c_custkey") % 4 == 1, F.concat(padded, F.lit("-6789")))
        .when(F.col("c_custkey") % 4 == 2, F.concat(k, F.lit(".0")))
        .otherwise(F.concat(F.lit("99"), padded))
    )
    return table(spark, sf, "customer").select("c_custkey", S.clean_zip(raw).alias("zip"))


@query("""SELECT n_nationkey, replace(n_name, 'NATION_1', 'North One') AS city, 'TX' AS state FROM nation""")
def metro_names(spark, sf):
    name = F.concat("n_name", F.lit("-Other, TX-OK Metro Area"))
    city, state = S.split_metro_name(name, {"NATION_1": "North One"})
    return table(spark, sf, "nation").select("n_nationkey", city.alias("city"), state.alias("state"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, nullif(l_tax, 0) AS tax, l_quantity AS q, l_discount AS d FROM lineitem)
 SELECT l_orderkey, l_linenumber, round(ln(p), 6) AS lp, round(exp(ln(p)), 2) AS p, round(exp(d), 6) AS ed,
  CASE WHEN d / tax BETWEEN 0 AND 2 THEN round(d / tax, 6) END AS ratio, CASE WHEN q BETWEEN 10 AND 40 THEN q END AS q_kept,
  round(ln(p / (q / 100000.0)), 6) AS per_capita, coalesce(tax, d) AS filled FROM x""")
def numeric_scalars(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("tax", F.nullif("l_tax", F.lit(0.0)))
    return df.select(
        "l_orderkey", "l_linenumber",
        r6(F.log("l_extendedprice")).alias("lp"),
        r6(F.exp(F.log("l_extendedprice")), 2).alias("p"),
        r6(F.exp("l_discount")).alias("ed"),
        r6(S.ratio_in_range("l_discount", "tax", 0, 2)).alias("ratio"),
        S.keep_in_range("l_quantity", 10, 40).alias("q_kept"),
        r6(S.log_per_capita("l_extendedprice", "l_quantity")).alias("per_capita"),
        F.coalesce("tax", "l_discount").alias("filled"),
    )


@query("""SELECT p_size, CAST(round_even(avg(p_retailprice) / 10000, 2) * 100 AS DOUBLE) AS pct FROM part GROUP BY 1""")
def whole_percent(spark, sf):
    return table(spark, sf, "part").groupBy("p_size").agg(S.percent(F.avg("p_retailprice") / 10000).alias("pct"))


@query("""SELECT o_orderkey, CAST(date_diff('day', DATE '1960-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day_no,
 CAST((year(o_orderdate) - 1960) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month_no,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(date_diff('day', DATE '1960-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) END AS from_text,
 CASE WHEN year(o_orderdate) >= 1940 + o_custkey % 76 THEN year(o_orderdate) - 1940 - o_custkey % 76 END AS age FROM orders""")
def date_scalars(spark, sf):
    df = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 9 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    number = S.day_number(day)
    return df.select(
        "o_orderkey", number.alias("day_no"), S.month_index(S.date_from_day(number)).alias("month_no"),
        S.day_number(text).alias("from_text"), S.age_at(F.year("o_orderdate"), 1940 + F.col("o_custkey") % 76).alias("age"),
    )


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 END AS rank,
 CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'low' WHEN p_type = 'PROMO' THEN 'mid' ELSE 'other' END AS kind,
 TRY_CAST(replace(p_brand, 'Brand#', CASE WHEN p_size > 40 THEN 'x' ELSE '' END) AS DOUBLE) AS brand FROM part""")
def maps_and_casts(spark, sf):
    brand = F.replace("p_brand", F.lit("Brand#"), F.when(F.col("p_size") > 40, "x").otherwise(""))
    df = table(spark, sf, "part").withColumn("brand", brand)
    return cast_columns(df, {"brand": "double"}).select(
        "p_partkey", S.map_values("p_type", {"ECONOMY": 1, "STANDARD": 2}).alias("rank"),
        S.category("p_type", {"low": ["ECONOMY", "SMALL"], "mid": ["PROMO"]}).alias("kind"), "brand",
    )


@query("""SELECT o_orderkey, c_custkey, c_mktsegment, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey
 LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2 LEFT JOIN region ON r_regionkey = n_regionkey""")
def crosswalk_joins(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(customer, "c_custkey")
    df = lookup(df, table(spark, sf, "nation").filter("n_regionkey <> 2"), "n_nationkey")
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return lookup(df, region, "n_regionkey").select("o_orderkey", "c_custkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT o_orderkey, c_custkey, o_totalprice FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def right_join(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return orders.join(customer, "c_custkey", "right")


@query("""WITH m AS (SELECT c_nationkey AS n, c_mktsegment AS s, avg(c_acctbal) AS mean FROM customer GROUP BY 1, 2)
 SELECT c_custkey, round(mean, 4) AS mean FROM customer JOIN m ON n = c_nationkey AND s = c_mktsegment""")
def multi_key_join(spark, sf):
    customer, keys = table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"]
    means = assert_unique(customer.groupBy(*keys).agg(r6(F.avg("c_acctbal"), 4).alias("mean")), keys)
    return lookup(customer.select("c_custkey", *keys), means, keys).select("c_custkey", "mean")


@query("""SELECT l_orderkey AS orderkey, l_extendedprice AS price FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice FROM orders""")
def append_same_schema(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_extendedprice").alias("price"))
    orders = table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("orderkey"))
    return items.unionByName(orders)


@query("""SELECT c_mktsegment, NULL AS c_nationkey, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT NULL, c_nationkey, count(*) FROM customer GROUP BY c_nationkey""")
def append_with_other_keys(spark, sf):
    customer = table(spark, sf, "customer")
    a, b = customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")), customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("SELECT least(5000, count(*)) AS n, least(5000, count(*)) AS ids, least(5000, count(*)) AS known FROM orders")
def sample_of_n(spark, sf):
    """A sample of fixed size without repeats, all from the table."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    drawn = sampling.sample_n(orders, "o_orderkey", 5000, seed=7)
    known = drawn.join(orders.withColumn("known", F.lit(1)), "o_orderkey", "left")
    return known.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("ids"), F.count("known").alias("known"))


@query("SELECT 7 AS groups, true AS whole FROM lineitem LIMIT 1")
def sample_of_groups(spark, sf):
    """Sampled groups keep all of their rows."""
    items = table(spark, sf, "lineitem").select("l_suppkey")
    drawn = sampling.sample_groups(items, "l_suppkey", 7, seed=3).groupBy("l_suppkey").agg(F.count("*").alias("a"))
    full = items.groupBy("l_suppkey").agg(F.count("*").alias("b"))
    both = drawn.join(full, "l_suppkey")
    return both.agg(F.count("*").cast("int").alias("groups"), F.bool_and(F.col("a") == F.col("b")).alias("whole"))


def spread(key: str) -> str:
    """A hash that both engines can compute, over the positive longs."""
    return f"(CAST({key} AS BIGINT) * 2654435761 % 4294967296) * 2147483648"


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {spread('o_orderkey')}, o_orderkey LIMIT 5000")
def sampled_rows(spark, sf):
    """The rows of a sample, under a hash that SQL has as well."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sample_n(orders, "o_orderkey", 5000, rank=F.expr(spread("o_orderkey")))


@query(f"""SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN
 (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY {spread('l_suppkey')}, l_suppkey LIMIT 7)""")
def rows_of_sampled_groups(spark, sf):
    items = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return sampling.sample_groups(items, "l_suppkey", 7, rank=F.expr(spread("l_suppkey")))
