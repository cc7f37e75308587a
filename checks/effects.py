"""Regression, imputation, screening and second-stage queries."""

from pyspark.sql import functions as F

from checks.roles import SQL_ROWS, query, r6, regression_rows, table
from plotmark.models import factors, fill, linear, moments, screening
from plotmark.models.additive import additive_curves, additive_ols
from plotmark.models.bias import oster_delta
from plotmark.plans.effects import additive_effect, group_premium, interaction_models, premium_relation
from plotmark.sources.contracts import lookup


def coefficients(fit, *keys):
    return fit.select(*keys, "term", r6("coef").alias("coef"), r6("se").alias("se"), "n")


# Cramer's rule for two regressors from centred sums a (x1x1), b (x1x2), c (x2x2), p (x1y), q (x2y), s (yy).
B1, B2 = "(p * c - q * b) / (a * c - b * b)", "(q * a - p * b) / (a * c - b * b)"


def within(partition: str) -> str:
    over = f"OVER (PARTITION BY {partition})"
    return f"w AS (SELECT *, y - avg(y) {over} AS yd, x1 - avg(x1) {over} AS u, x2 - avg(x2) {over} AS v FROM d)"


SUMS = "sum(u * u) AS a, sum(u * v) AS b, sum(v * v) AS c, sum(u * yd) AS p, sum(v * yd) AS q, sum(yd * yd) AS s, count(*) AS n"


def plain_se(own: str) -> str:
    return f"sqrt((s - b1 * p - b2 * q) / (n - 2 - g) * {own} / (a * c - b * b))"


@query(f"""WITH {SQL_ROWS}, {within('l_suppkey')} SELECT l_suppkey, count(*) AS n, round(sum(yd * yd), 4) AS y_ss, round(sum(u * v), 4) AS uv FROM w GROUP BY 1""")
def demean(spark, sf):
    df = moments.demean(regression_rows(spark, sf), ["y", "x1", "x2"], "l_suppkey")
    y, u, v = F.col("y_dm"), F.col("x1_dm"), F.col("x2_dm")
    return df.groupBy("l_suppkey").agg(F.count("*").alias("n"), r6(F.sum(y * y), 4).alias("y_ss"), r6(F.sum(u * v), 4).alias("uv"))


GRAM = ["l_quantity", "l_discount", "x1", "x2", "y", "one"]


@query(f"""WITH {SQL_ROWS}, x AS (SELECT *, 1.0 AS one FROM d)
 SELECT * FROM ({' UNION ALL '.join(f"SELECT {i + 1} AS i, {j + 1} AS j, round(sum({a}::DOUBLE * {b}), 2) AS value FROM x"
   for i, a in enumerate(GRAM) for j, b in enumerate(GRAM) if i <= j)})""")
def gram(spark, sf):
    df = regression_rows(spark, sf).withColumn("one", F.lit(1.0))
    return moments.gram(df, GRAM).withColumn("value", r6("value", 2))


DUMMIES = [f"d{k}" for k in range(12)]


@query(f"""WITH {SQL_ROWS}, x AS (SELECT y, {', '.join(f'CASE WHEN CAST(l_quantity AS BIGINT) % 13 = {k} THEN 1 ELSE 0 END AS d{k}' for k in range(12))} FROM d)
 SELECT * FROM ({' UNION ALL '.join(f"SELECT {i + 1} AS i, {j + 1} AS j, CAST(round(sum({a} * {b}), 2) AS DOUBLE) AS value FROM x"
   for i, a in enumerate([*DUMMIES, 'y']) for j, b in enumerate([*DUMMIES, 'y']) if i <= j)})""")
def gram_of_many_columns(spark, sf):
    """The per-batch path: thirteen columns, summed by tasks in Arrow batches."""
    k = F.col("l_quantity").cast("long") % 13
    df = regression_rows(spark, sf).withColumns({d: F.when(k == i, 1).otherwise(0) for i, d in enumerate(DUMMIES)})
    return moments.gram(df, [*DUMMIES, "y"]).withColumn("value", r6("value", 2))


@query(f"""WITH {SQL_ROWS}, w AS (SELECT *, y - avg(y) OVER () AS yd, x1 - avg(x1) OVER () AS u, x2 - avg(x2) OVER () AS v FROM d),
 m AS (SELECT {SUMS}, 1 AS g, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM w), f AS (SELECT *, {B1} AS b1, {B2} AS b2 FROM m)
 SELECT 'x1' AS term, round(b1, 6) AS coef, round({plain_se('c')}, 6) AS se, n FROM f
 UNION ALL SELECT 'x2', round(b2, 6), round({plain_se('a')}, 6), n FROM f
 UNION ALL SELECT '(intercept)', round(my - b1 * m1 - b2 * m2, 6),
   round(sqrt((s - b1 * p - b2 * q) / (n - 3) * (1.0 / n + (m1 * m1 * c - 2 * m1 * m2 * b + m2 * m2 * a) / (a * c - b * b))), 6), n FROM f""")
def plain_ols(spark, sf):
    return coefficients(linear.ols(regression_rows(spark, sf), "y", ["x1", "x2"]))


@query(f"""WITH {SQL_ROWS}, {within('l_suppkey')}, m AS (SELECT {SUMS}, count(DISTINCT l_suppkey) AS g FROM w), f AS (SELECT *, {B1} AS b1, {B2} AS b2 FROM m)
 SELECT 'x1' AS term, round(b1, 6) AS coef, round({plain_se('c')}, 6) AS se, n FROM f
 UNION ALL SELECT 'x2', round(b2, 6), round({plain_se('a')}, 6), n FROM f""")
def absorb_ols(spark, sf):
    return coefficients(linear.ols(regression_rows(spark, sf), "y", ["x1", "x2"], "l_suppkey"))


def sql_clustered(partition: str, cluster: str, label: str = "", rows: str | None = None, more: int = 0) -> str:
    """``rows`` may demean further, which takes up ``more`` parameters."""
    return f"""{rows or within(partition)}, m AS (SELECT {SUMS}, count(DISTINCT ({partition})) + {more} AS g FROM w), f AS (SELECT *, {B1} AS b1, {B2} AS b2 FROM m),
 r AS (SELECT w.*, yd - b1 * u - b2 * v AS e FROM w, f), sc AS (SELECT sum(u * e) AS s1, sum(v * e) AS s2 FROM r GROUP BY {cluster}),
 k AS (SELECT sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22, count(*) AS cl FROM sc),
 o AS (SELECT *, cl / (cl - 1.0) * (n - 1.0) / (n - 2 - g) / ((a * c - b * b) * (a * c - b * b)) AS h FROM f, k)
 SELECT {label}'x1' AS term, round(b1, 6) AS coef, round(sqrt(h * (c * c * m11 - 2 * b * c * m12 + b * b * m22)), 6) AS se, n FROM o
 UNION ALL SELECT {label}'x2', round(b2, 6), round(sqrt(h * (b * b * m11 - 2 * a * b * m12 + a * a * m22)), 6), n FROM o"""


@query(f"WITH {SQL_ROWS}, {sql_clustered('l_suppkey', 's_nationkey')}")
def cluster_se(spark, sf):
    return coefficients(linear.ols(regression_rows(spark, sf), "y", ["x1", "x2"], "l_suppkey", "s_nationkey"))


# Double demeaning: around suppliers, then less what the line status explains of the rest.
CROSSED = f"""{within('l_suppkey').replace('w AS', 'own AS', 1).replace('SELECT *,', "SELECT *, CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0.0 END - avg(CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY l_suppkey) AS z,", 1)},
 by_z AS (SELECT sum(yd * z) / sum(z * z) AS ky, sum(u * z) / sum(z * z) AS ku, sum(v * z) / sum(z * z) AS kv FROM own),
 w AS (SELECT own.* REPLACE (yd - ky * z AS yd, u - ku * z AS u, v - kv * z AS v) FROM own, by_z)"""


@query(f"WITH {SQL_ROWS}, {sql_clustered('l_suppkey', 's_nationkey', rows=CROSSED, more=1)}")
def crossed_factor_cluster_se(spark, sf):
    """A factor that crosses the absorbed effect, from counts and level sums, with clustered errors."""
    return coefficients(factors.factor_ols(regression_rows(spark, sf), "y", ["x1", "x2"], ["l_linestatus"], "l_suppkey", "s_nationkey"))


@query(f"WITH {SQL_ROWS}, {sql_clustered('l_suppkey, l_linestatus', 's_nationkey')}")
def factor_of_many_levels(spark, sf):
    """A factor of every supplier and status beside the absorbed status: thousands of levels, no column for any."""
    df = regression_rows(spark, sf).withColumn("place", F.concat_ws("-", "l_linestatus", "l_suppkey"))
    return coefficients(factors.factor_ols(df, "y", ["x1", "x2"], ["place"], "l_linestatus", "s_nationkey"))


@query(f"WITH {SQL_ROWS}, {sql_clustered('l_suppkey, l_linestatus', 'l_returnflag, s_nationkey')}")
def two_way_effect_crossed_clusters(spark, sf):
    """Absorbed pairs of keys, with clusters that cut across them."""
    df = regression_rows(spark, sf)
    return coefficients(linear.ols(df, "y", ["x1", "x2"], ["l_suppkey", "l_linestatus"], ["l_returnflag", "s_nationkey"]))


@query(f"""WITH {SQL_ROWS}, {within('s_nationkey, l_suppkey')}, m AS (SELECT s_nationkey, {SUMS}, count(DISTINCT l_suppkey) AS g FROM w GROUP BY 1),
 f AS (SELECT *, {B1} AS b1, {B2} AS b2 FROM m), t AS (
 SELECT s_nationkey, 'x1' AS term, b1 AS coef, {plain_se('c')} AS se, n FROM f UNION ALL SELECT s_nationkey, 'x2', b2, {plain_se('a')}, n FROM f)
 SELECT s_nationkey, term, round(coef, 6) AS coef, round(se, 6) AS se, n, round(coef - 1.96 * se, 6) AS lo, round(coef + 1.96 * se, 6) AS hi FROM t""")
def grouped_ols(spark, sf):
    """One fit per nation, with suppliers absorbed, from one aggregation."""
    fit = linear.ols(regression_rows(spark, sf), "y", ["x1", "x2"], "l_suppkey", by="s_nationkey")
    return fit.select("s_nationkey", "term", *[r6(c).alias(c) for c in ("coef", "se", "lo", "hi")], "n")


# The eight traits of the interaction models, in SQL.
TRAITS = {
    "ageAtSale": "l_quantity", "age14plus": "CASE WHEN l_quantity >= 14 THEN 1 ELSE 0 END", "age5under": "CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END",
    "z_lba": "(l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER ()",
    "z_llota": "(ln(l_quantity) - avg(ln(l_quantity)) OVER ()) / stddev_samp(ln(l_quantity)) OVER ()",
    "z_tax_rate": "(l_tax - avg(l_tax) OVER ()) / stddev_samp(l_tax) OVER ()",
    "subdiv_size": "l_linenumber * 12", "subdiv_50plus": "CASE WHEN l_linenumber * 12 >= 50 THEN 1 ELSE 0 END",
}


def sql_interaction(name: str, trait: str) -> str:
    rows = f"""d AS (SELECT l_suppkey, s_nationkey, y, x1, x1 * t AS x2 FROM (SELECT l_suppkey, s_nationkey, ln(l_extendedprice + 1) AS y,
      CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS x1, ({trait})::DOUBLE AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey))"""
    return f"SELECT * FROM (WITH {rows}, {sql_clustered('l_suppkey', 's_nationkey', f"'{name}' AS model, ")})"


@query(f"""SELECT model, CASE term WHEN 'x1' THEN 'x1' ELSE 'x1_x_' || model END AS term, coef, se, n FROM (
 {' UNION ALL '.join(sql_interaction(*t) for t in TRAITS.items())})""")
def all_interaction_models(spark, sf):
    """The eight interactions with an absorbed effect and clustered errors."""
    lines = table(spark, sf, "lineitem").join(
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey"
    )
    df = lines.withColumns(
        {
            "y": F.log1p("l_extendedprice"), "x1": (F.col("l_returnflag") == "R").cast("int"), "ageAtSale": F.col("l_quantity"),
            "lba": F.col("l_discount"), "llota": F.log("l_quantity"), "tax_rate": F.col("l_tax"), "subdiv_size": F.col("l_linenumber") * 12,
        }
    )
    return coefficients(interaction_models(df, "y", "x1", [], ["l_suppkey"], "s_nationkey"), "model")


# Dummies for twelve levels within each line status, with the status absorbed, equal absorbed pairs of status and level.
PAIR = "l_linestatus, CAST(l_quantity AS BIGINT) % 13"
WIDE = [f"{status}{k}" for status in "FO" for k in range(1, 13)]


def wide_rows(spark, sf):
    level = F.col("l_quantity").cast("long") % 13
    return regression_rows(spark, sf).withColumns(
        {w: ((F.col("l_linestatus") == w[0]) & (level == int(w[1:]))).cast("int") for w in WIDE}
    )


def of_interest(fit, *keys):
    return coefficients(fit.filter(F.col("term").isin("x1", "x2")), *keys)


@query(f"""WITH {SQL_ROWS}, {within(PAIR)}, m AS (SELECT {SUMS}, count(DISTINCT ({PAIR})) AS g FROM w), f AS (SELECT *, {B1} AS b1, {B2} AS b2 FROM m)
 SELECT 'x1' AS term, round(b1, 6) AS coef, round({plain_se('c')}, 6) AS se, n FROM f
 UNION ALL SELECT 'x2', round(b2, 6), round({plain_se('a')}, 6), n FROM f""")
def wide_absorb_ols(spark, sf):
    """Twenty-six regressors and an absorbed effect: the batch path."""
    return of_interest(linear.ols(wide_rows(spark, sf), "y", ["x1", "x2", *WIDE], "l_linestatus"))


@query(f"WITH {SQL_ROWS}, {sql_clustered(PAIR, 's_nationkey')}")
def wide_cluster_se(spark, sf):
    return of_interest(linear.ols(wide_rows(spark, sf), "y", ["x1", "x2", *WIDE], "l_linestatus", "s_nationkey"))


@query(f"""WITH {SQL_ROWS}, {within('s_nationkey, ' + PAIR)}, m AS (SELECT s_nationkey, {SUMS}, count(DISTINCT ({PAIR})) AS g FROM w GROUP BY 1),
 f AS (SELECT *, {B1} AS b1, {B2} AS b2 FROM m), t AS (
 SELECT s_nationkey, 'x1' AS term, b1 AS coef, {plain_se('c')} AS se, n FROM f UNION ALL SELECT s_nationkey, 'x2', b2, {plain_se('a')}, n FROM f)
 SELECT s_nationkey, term, round(coef, 6) AS coef, round(se, 6) AS se, n FROM t""")
def wide_grouped_ols(spark, sf):
    fit = linear.ols(wide_rows(spark, sf), "y", ["x1", "x2", *WIDE], "l_linestatus", by="s_nationkey")
    return of_interest(fit, "s_nationkey")


@query(f"""WITH {SQL_ROWS}, z AS (SELECT s_nationkey, count(*) AS n, count(DISTINCT CASE WHEN s_nationkey % 2 = 0 THEN 1.0 ELSE x1 END) AS k FROM d GROUP BY 1)
 SELECT s_nationkey, n, CASE WHEN k < 2 THEN 'collinear' END AS reason FROM z""")
def singular_groups(spark, sf):
    """A group where the treatment never varies is reported, not dropped, and does not stop the others."""
    df = regression_rows(spark, sf).withColumn("x1", F.when(F.col("s_nationkey") % 2 == 0, 1).otherwise(F.col("x1")))
    fit = linear.ols(df, "y", ["x1", "x2"], "l_suppkey", by="s_nationkey").filter("term = 'x1'")
    return fit.select("s_nationkey", "n", "reason")


@query(f"""WITH d0 AS (WITH {SQL_ROWS} SELECT * FROM d), {', '.join(f'''r{i} AS (WITH d AS (SELECT * FROM d0 WHERE {w}), {sql_clustered(p, 's_nationkey', f"'{n}' AS model, ")})'''
  for i, (n, p, w) in enumerate([('all', 'l_suppkey', 'true'), ('open', 'l_suppkey', "l_linestatus = 'O'"), ('by status', 'l_suppkey, l_linestatus', 'true')]))}
 SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2""")
def model_variants(spark, sf):
    spec = {"y": "y", "x": ["x1", "x2"], "cluster": "s_nationkey"}
    specs = {
        "all": {**spec, "absorb": "l_suppkey"},
        "open": {**spec, "absorb": "l_suppkey", "where": F.col("l_linestatus") == "O"},
        "by status": {**spec, "absorb": ["l_suppkey", "l_linestatus"]},
    }
    return coefficients(linear.fit_specs(regression_rows(spark, sf), specs), "model")


# Two-sided thresholds of t for many degrees of freedom.
SQL_STARS = "CASE WHEN abs({t}) > 2.5766 THEN '***' WHEN abs({t}) > 1.9603 THEN '**' WHEN abs({t}) > 1.6451 THEN '*' ELSE '' END"
SQL_T = "(b{k} / sqrt((s{k} - b{k} * p{k}) / (n - 2) / sx{x}))"


def sql_cell(k: int, x: int, digits: int) -> str:
    t, se = SQL_T.format(k=k, x=x), f"sqrt((s{k} - b{k} * p{k}) / (n - 2) / sx{x})"
    return f"printf('%.{digits}f%s (%.{digits}f)', b{k}, {SQL_STARS.format(t=t)}, {se})"


def sql_line(k: int, y: str, x: str) -> str:
    return f"regr_slope({y}, {x}) AS b{k}, regr_syy({y}, {x}) AS s{k}, regr_sxy({y}, {x}) AS p{k}"


@query(f"""WITH {SQL_ROWS}, s AS (SELECT {sql_line(1, 'y', 'l_quantity')}, {sql_line(2, 'l_extendedprice', 'l_quantity')},
  {sql_line(3, 'y', 'l_discount')}, {sql_line(4, 'l_extendedprice', 'l_discount')}, count(*) AS n,
  regr_sxx(y, l_quantity) AS sx1, regr_sxx(y, l_discount) AS sx2 FROM d)
 SELECT 'l_quantity' AS term, {sql_cell(1, 1, 3)} AS log_price, {sql_cell(2, 1, 1)} AS price FROM s
 UNION ALL SELECT 'l_discount', {sql_cell(3, 2, 3)}, {sql_cell(4, 2, 1)} FROM s""")
def coefficient_table(spark, sf):
    """Terms by model with the stars of significant terms; each term is fitted alone."""
    df = regression_rows(spark, sf)
    out = None
    for y, digits, name in (("y", 3, "log_price"), ("l_extendedprice", 1, "price")):
        specs = {x: {"y": y, "x": [x]} for x in ("l_quantity", "l_discount")}
        fits = linear.fit_specs(df, specs).filter("term <> '(intercept)'").withColumn("model", F.lit(name))
        shown = linear.coef_table(fits, [name], digits)
        out = shown if out is None else out.join(shown, "term")
    return out


OSTER_ROWS = "SELECT l_suppkey, y, x1 + l_quantity / 50 AS x, l_quantity / 10 + x2 AS w FROM d"


def sql_oster(rows: str, total: str = "var_pop(y)") -> str:
    """Short and long regression of y on x without and with w, from the moments of the rows.

    ``total`` is the variance of y that shares of variance refer to."""
    return f"""WITH {SQL_ROWS}, x AS ({rows}),
 m AS (SELECT var_pop(x) AS vx, var_pop(w) AS vw, var_pop(y) AS vy, {total} AS ty, covar_pop(x, w) AS xw, covar_pop(x, y) AS xy, covar_pop(w, y) AS wy FROM x),
 c AS (SELECT *, xy / vx AS b0, (ty - vy + xy * xy / vx) / ty AS r0, vx - xw * xw / vw AS tx, (xy * vw - wy * xw) / (vx * vw - xw * xw) AS b1,
   (wy * vx - xy * xw) / (vx * vw - xw * xw) AS bw FROM m), r AS (SELECT *, (ty - vy + b1 * xy + bw * wy) / ty AS r1 FROM c),
 o AS (SELECT *, b0 - b1 AS mv, (r1 - r0) * ty AS ex, 0.3 * r1 * ty AS un FROM r)
 SELECT round(b0, 6) AS beta_short, round(b1, 6) AS beta_long, round(r0, 8) AS r2_short, round(r1, 8) AS r2_long,
  round((b1 * ex * tx + b1 * vx * tx * mv * mv + 2 * b1 * b1 * tx * mv * vx + b1 ** 3 * (tx * vx - tx * tx)) /
   (un * mv * vx + b1 * un * (vx - tx) + b1 * b1 * tx * mv * vx + b1 ** 3 * (tx * vx - tx * tx)), 4) AS delta FROM o"""


def oster_columns(found):
    return found.select(
        r6("beta_short").alias("beta_short"), r6("beta_long").alias("beta_long"), r6("r2_short", 8).alias("r2_short"),
        r6("r2_long", 8).alias("r2_long"), r6("delta", 4).alias("delta"),
    )


def oster_rows(spark, sf):
    x, w = F.col("x1") + F.col("l_quantity") / 50, F.col("l_quantity") / 10 + F.col("x2")
    return regression_rows(spark, sf).select("l_suppkey", "y", x.alias("x"), w.alias("w"))


@query(sql_oster(OSTER_ROWS))
def oster_bound(spark, sf):
    return oster_columns(oster_delta(oster_rows(spark, sf), "y", "x", ["w"]))


@query(sql_oster(f"SELECT {', '.join(f'{c} - avg({c}) OVER (PARTITION BY l_suppkey) AS {c}' for c in 'yxw')} FROM ({OSTER_ROWS})"))
def oster_bound_absorbed(spark, sf):
    """The bound with an absorbed effect in both regressions."""
    return oster_columns(oster_delta(oster_rows(spark, sf), "y", "x", ["w"], absorb="l_suppkey"))


@query(sql_oster(f"""SELECT y - sum(y * z) OVER () / sum(z * z) OVER () * z AS y, x - sum(x * z) OVER () / sum(z * z) OVER () * z AS x,
   w - sum(w * z) OVER () / sum(z * z) OVER () * z AS w, y AS raw FROM (SELECT y - avg(y) OVER () AS y, x - avg(x) OVER () AS x, w - avg(w) OVER () AS w,
   l_discount - avg(l_discount) OVER () AS z FROM (SELECT l_discount, y, x1 + l_quantity / 50 AS x, l_quantity / 10 + x2 AS w FROM d))""", "var_pop(raw)"))
def oster_bound_two_control_sets(spark, sf):
    """The bound with a control that stands in both regressions; shares of variance are of the whole response."""
    df = regression_rows(spark, sf).select(
        "y", "l_discount", (F.col("x1") + F.col("l_quantity") / 50).alias("x"), (F.col("l_quantity") / 10 + F.col("x2")).alias("w")
    )
    return oster_columns(oster_delta(df, "y", "x", ["w"], ["l_discount"]))


@query(f"""WITH {SQL_ROWS}, h AS (SELECT l_suppkey, l_linestatus, y, x1, x1 * l_quantity AS x2 FROM d),
 f AS (WITH d AS (SELECT * FROM h), {within('l_suppkey')}, m AS (SELECT {SUMS}, count(DISTINCT l_suppkey) AS g FROM w), f AS (SELECT *, {B1} AS b1, {B2} AS b2 FROM m)
 SELECT 'x1' AS term, round(b1, 6) AS coef, round({plain_se('c')}, 6) AS se, n FROM f
 UNION ALL SELECT 'x1_x_l_quantity', round(b2, 6), round({plain_se('a')}, 6), n FROM f) SELECT * FROM f""")
def interaction_model(spark, sf):
    from plotmark.operators.summaries import interact

    df = interact(regression_rows(spark, sf), "x1", ["l_quantity"])
    return coefficients(linear.ols(df, "y", ["x1", "x1_x_l_quantity"], "l_suppkey"))


TRAITS = ["l_quantity", "l_discount", "x2"]


@query(f"""WITH {SQL_ROWS} {' UNION ALL '.join(f"SELECT '{t}' AS trait, regr_count(y, {t})::BIGINT AS n, round(regr_slope(y, {t}), 6) AS coef, round(regr_intercept(y, {t}), 6) AS intercept, "
  f"round(sqrt((regr_syy(y, {t}) - regr_slope(y, {t}) * regr_sxy(y, {t})) / (count(*) - 2) / regr_sxx(y, {t})), 6) AS se FROM d" for t in TRAITS)}""")
def trait_screen(spark, sf):
    found = screening.trait_screen(regression_rows(spark, sf), "y", TRAITS)
    return found.select("trait", "n", r6("coef").alias("coef"), r6("intercept").alias("intercept"), r6("se").alias("se"))


@query("""SELECT c_mktsegment, count(*) AS n, round(corr(c_acctbal, c_nationkey), 6) AS r, round(regr_slope(c_acctbal, c_nationkey), 4) AS coef,
 round(regr_intercept(c_acctbal, c_nationkey), 4) AS intercept FROM customer GROUP BY 1""")
def corr_fit(spark, sf):
    customer = table(spark, sf, "customer")
    r = screening.correlation(customer, "c_acctbal", "c_nationkey", ["c_mktsegment"]).select("c_mktsegment", r6("r").alias("r"))
    line = screening.fitted_line(customer, "c_acctbal", "c_nationkey", ["c_mktsegment"])
    return line.join(r, "c_mktsegment").select("c_mktsegment", "n", "r", r6("coef", 4).alias("coef"), r6("intercept", 4).alias("intercept"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(min(m), 6) AS lo, round(max(m), 6) AS hi FROM (
 SELECT l_returnflag, l_linestatus, avg(ln(l_extendedprice + 1)) OVER (PARTITION BY l_returnflag, l_linestatus) AS m FROM lineitem) GROUP BY 1, 2""")
def feature_index(spark, sf):
    """Fitted values of a factor per group are the group's means by level."""
    df = fill.feature_index(regression_rows(spark, sf), "y", ["l_returnflag"], by="l_linestatus")
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r6(F.min("index")).alias("lo"), r6(F.max("index")).alias("hi")
    )


@query("""WITH x AS (SELECT l_partkey, l_extendedprice AS price, CASE WHEN l_partkey % 10 > 0 THEN l_extendedprice * (1 - l_discount) END AS net FROM lineitem),
 f AS (SELECT regr_slope(net, price) AS b, regr_intercept(net, price) AS a FROM x)
 SELECT l_partkey, count(*) AS n, round(sum(coalesce(net, a + b * price)) + 0.00303, 2) AS net FROM x, f GROUP BY 1""")
def impute(spark, sf):
    net = F.when(F.col("l_partkey") % 10 > 0, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    df = table(spark, sf, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("price"), net.alias("net"))
    filled = fill.impute_linear(df, ["net"], ["price"])
    return filled.groupBy("l_partkey").agg(F.count("*").alias("n"), r6(F.sum("net") + 0.00303, 2).alias("net"))


@query()
def additive_model(spark, sf):
    """Spline fit; SQL has no counterpart, see the tests for its accuracy."""
    df = regression_rows(spark, sf)
    fit = additive_ols(df, "y", ["x1"], ["l_quantity", "x2"], [("l_discount", "l_tax")])
    return fit.select("term", "kind", r6("coef", 3).alias("coef"), "n")


@query()
def additive_model_by_group(spark, sf):
    df = regression_rows(spark, sf)
    fit = additive_effect(df, "y", "x1", ["l_linestatus"], ["x2"], ["l_quantity"], ("l_discount", "l_tax"), "l_suppkey", by="s_nationkey")
    return fit.filter("kind = 'linear'").select("s_nationkey", "term", r6("coef", 3).alias("coef"), "n")


@query("""WITH d AS (SELECT s_nationkey, l_discount AS x, l_quantity + 100 * s_nationkey AS z, 7 + 3 * l_discount + 0.5 * (l_quantity + 100 * s_nationkey) AS y
   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
 SELECT s_nationkey, round(regr_slope(y - 0.5 * z, x), 4) AS coef, count(*) AS n, 1.0::DOUBLE AS r2 FROM d GROUP BY 1""")
def additive_of_linear_data(spark, sf):
    """Linear data lie in the smooth's unpenalised part, so each group is fitted exactly on its own range."""
    z = F.col("l_quantity") + 100 * F.col("s_nationkey")
    df = regression_rows(spark, sf).select("s_nationkey", F.col("l_discount").alias("x"), z.alias("z"), (7 + 3 * F.col("l_discount") + 0.5 * z).alias("y"))
    fit = additive_ols(df, "y", ["x"], ["z"], by="s_nationkey")
    return fit.filter("kind = 'linear'").select("s_nationkey", r6("coef", 4).alias("coef"), "n", r6("r2", 4).alias("r2"))


# Columns less what earlier ones explain, by supplier's nation: u1 of the binned column, u2 of its square, u3 of its cube.
def residual(new: str, value: str, past: list[str]) -> str:
    over = "OVER (PARTITION BY s_nationkey)"
    parts = [f"avg({value}) {over}", *[f"{u} * sum({value} * {u}) {over} / nullif(sum({u} * {u}) {over}, 0)" for u in past]]
    return f"{value} - {' - '.join(parts)} AS {new}"


BINS = 41
SQL_CUBIC = f"""{SQL_ROWS}, e AS (SELECT *, min(l_quantity) OVER (PARTITION BY s_nationkey) AS lo, max(l_quantity) OVER (PARTITION BY s_nationkey) AS hi FROM d),
 z AS (SELECT *, 2 * floor((l_quantity - lo) / (hi - lo)::DOUBLE * {BINS - 1} + 0.5) / {BINS - 1} - 1 AS z FROM e),
 r1 AS (SELECT *, {residual('u1', 'z', [])} FROM z),
 r2 AS (SELECT *, {residual('u2', 'z * z', ['u1'])} FROM r1),
 r3 AS (SELECT *, {residual('u3', 'z * z * z', ['u1', 'u2'])} FROM r2),
 t AS (SELECT *, {residual('tx', 'x1', ['u1', 'u2', 'u3'])}, {residual('ty', 'y', ['u1', 'u2', 'u3'])} FROM r3),
 f AS (SELECT s_nationkey, sum(tx * ty) / sum(tx * tx) AS b, sum(tx * tx) AS a, sum(ty * ty) AS s, count(*) AS n FROM t GROUP BY 1)"""


@query(f"""WITH {SQL_CUBIC} SELECT s_nationkey, round(b, 5) AS coef, round(sqrt((s - b * b * a) / (n - 5) / a), 5) AS se, n FROM f""")
def additive_model_in_bins(spark, sf):
    """Without penalty, a spline of one piece is a cubic, so that SQL can state the binned fit."""
    fit = additive_ols(regression_rows(spark, sf), "y", ["x1"], ["l_quantity"], by="s_nationkey", size=4, bins=BINS, penalty=0)
    return fit.filter("kind = 'linear'").select("s_nationkey", r6("coef", 5).alias("coef"), r6("se", 5).alias("se"), "n")


@query(f"""WITH {SQL_CUBIC}, k AS (SELECT s_nationkey, (p - 1) / 5 AS k, hi, lo FROM (SELECT DISTINCT s_nationkey, lo, hi FROM e) CROSS JOIN (SELECT unnest(generate_series(1, 6)) AS p)),
 h AS (SELECT r3.*, y - b * x1 AS v FROM r3 JOIN f USING (s_nationkey)),
 c AS (SELECT s_nationkey, avg(z) AS m1, sum(z * z * u1) / sum(u1 * u1) AS a21, avg(z * z) AS m2, avg(z * z * z) AS m3,
   sum(z * z * z * u1) / sum(u1 * u1) AS a31, sum(z * z * z * u2) / sum(u2 * u2) AS a32,
   sum(v * u1) / sum(u1 * u1) AS g1, sum(v * u2) / sum(u2 * u2) AS g2, sum(v * u3) / sum(u3 * u3) AS g3 FROM h GROUP BY 1),
 q AS (SELECT *, 2 * k - 1 AS w FROM k JOIN c USING (s_nationkey)),
 q1 AS (SELECT *, w - m1 AS o1 FROM q), q2 AS (SELECT *, w * w - m2 - a21 * o1 AS o2 FROM q1), q3 AS (SELECT *, w * w * w - m3 - a31 * o1 - a32 * o2 AS o3 FROM q2)
 SELECT s_nationkey, round(lo + k * (hi - lo), 4) AS x, round(g1 * o1 + g2 * o2 + g3 * o3, 4) AS fit FROM q3""")
def additive_curve(spark, sf):
    """The curve of the same fit at six points of each group's range."""
    curves = additive_curves(regression_rows(spark, sf), "y", ["x1"], ["l_quantity"], by="s_nationkey", size=4, bins=BINS, penalty=0, points=6)
    return curves.select("s_nationkey", r6("x", 4).alias("x"), r6("fit", 4).alias("fit"))


@query()
def additive_smooth_terms(spark, sf):
    """Tests and degrees of freedom of the smooths; SQL has no counterpart, see the tests."""
    df = regression_rows(spark, sf)
    fit = additive_ols(df, "y", ["x1"], ["l_quantity", "x2"], [("l_discount", "l_tax")], bins=100)
    return fit.filter("kind = 'smooth'").select("term", r6("edf", 2).alias("edf"), r6("p", 4).alias("p"), "n")


@query(f"""WITH {SQL_ROWS}, {within('s_nationkey, l_suppkey')}, m AS (SELECT s_nationkey, {SUMS}, avg(x1) AS share, count(DISTINCT l_suppkey) AS g FROM w GROUP BY 1),
 f AS (SELECT *, {B1} AS b1, {B2} AS b2 FROM m)
 SELECT s_nationkey, n AS obs, round(share, 6) AS share, round(b1, 6) AS beta, round({plain_se('c')}, 6) AS se, r_name AS region
 FROM f JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def group_effects(spark, sf):
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    regions = table(spark, sf, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").alias("s_nationkey"), "region")
    found = group_premium(regression_rows(spark, sf), "s_nationkey", "y", "x1", ["x2"], "l_suppkey", regions=regions)
    return found.select("s_nationkey", "obs", r6("share").alias("share"), r6("beta").alias("beta"), r6("se").alias("se"), "region")


@query(f"""WITH {SQL_ROWS}, g AS (SELECT s_nationkey, count(*) AS n, regr_slope(y, x1) AS beta, avg(x1) AS share FROM d GROUP BY 1 HAVING count(*) >= 1000)
 SELECT count(*) AS n, round(corr(beta, share), 6) AS r, round(regr_slope(beta, share), 6) AS slope FROM g""")
def effect_against_share(spark, sf):
    found = group_premium(regression_rows(spark, sf), "s_nationkey", "y", "x1", [], [])
    r, line = premium_relation(found, "share", 1000)
    return r.join(line.select("n", "coef"), "n").select("n", r6("r").alias("r"), r6("coef").alias("slope"))


@query("""WITH c AS (SELECT c_nationkey AS code, round(avg(c_acctbal), 4) AS coef, count(*) AS "N" FROM customer GROUP BY 1),
 s AS (SELECT s_nationkey AS code, round(avg(s_acctbal), 4) AS trait FROM supplier GROUP BY 1)
 SELECT c.code, c.coef, c."N"::DOUBLE AS "N", s.trait, n_regionkey AS zoning FROM c LEFT JOIN s USING (code) JOIN nation ON n_nationkey = c.code""")
def second_stage(spark, sf):
    """Coefficients by code with one table matched by code and one by the parts of a name."""
    fits = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(
        F.lit("gam").alias("regtype"), r6(F.avg("c_acctbal"), 4).cast("string").alias("coef"),
        F.lit("n/a").alias("se"), F.count("*").cast("string").alias("N"),
    )
    fits = fits.unionByName(fits.withColumn("regtype", F.lit("ols")))
    traits = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("code")).agg(r6(F.avg("s_acctbal"), 4).alias("trait"))
    nation = table(spark, sf, "nation")
    names = nation.select(F.col("n_nationkey").alias("code"), F.concat("n_name", F.lit("-B, TX-OK Metro")).alias("msaname"))
    zoning = nation.select(F.concat("n_name", F.lit(", TX")).alias("msaname99"), F.col("n_regionkey").alias("zoning"))
    found = screening.second_stage(fits, "gam", [traits], [(zoning, "msaname99", {})], "code", (names, "msaname"))
    return found.select("code", "coef", "N", "trait", "zoning")
