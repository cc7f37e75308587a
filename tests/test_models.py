"""Regressions against explicit NumPy solutions and simulated truths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotmark.models import additive, bias, fill, linear, moments, numeric, screening


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 1500
    g, c = rng.integers(0, 40, n), rng.integers(0, 12, n)
    x = rng.normal(size=(n, 14)) + g[:, None] * 0.1
    y = x @ np.linspace(-1, 1, 14) + g * 0.3 + rng.normal(size=n) * (1 + c * 0.1)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(14)])
    return pdf.assign(g=g, c=c, s=np.where(c < 6, "a", "b"), y=y)


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data)


def explicit(pdf, x, absorb, cluster):
    """Dummy-variable least squares with clustered errors, solved directly."""
    dummies = pd.get_dummies(pdf[absorb].astype(str).agg("|".join, axis=1)).to_numpy(float) if absorb else np.ones((len(pdf), 1))
    full = np.hstack([pdf[x].to_numpy(float), dummies])
    y = pdf.y.to_numpy()
    inv = np.linalg.inv(full.T @ full)
    b = inv @ full.T @ y
    u = y - full @ b
    n, k = full.shape
    if not cluster:
        v = inv * (u @ u) / (n - k)
    else:
        scores = np.array([full[i].T @ u[i] for i in pdf.groupby(cluster).indices.values()])
        groups = len(scores)
        v = inv @ scores.T @ scores @ inv * groups / (groups - 1) * (n - 1) / (n - k)
    return b[: len(x)], np.sqrt(np.diag(v))[: len(x)]


@pytest.mark.parametrize("width", [3, 14])
@pytest.mark.parametrize("absorb,cluster", [([], []), (["g"], []), (["g"], ["c"]), (["g", "s"], ["c"]), ([], ["c", "s"])])
def test_ols(rows, data, width, absorb, cluster):
    x = [f"x{i}" for i in range(width)]
    fit = linear.ols(rows, "y", x, absorb or None, cluster or None).toPandas().set_index("term").loc[x]
    b, se = explicit(data, x, absorb, cluster)
    np.testing.assert_allclose(fit.coef, b, rtol=1e-8)
    np.testing.assert_allclose(fit.se, se, rtol=1e-8)


@pytest.mark.parametrize("width", [2, 13])
def test_ols_by_group(rows, data, width):
    x = [f"x{i}" for i in range(width)]
    fit = linear.ols(rows, "y", x, "g", "c", by="s").toPandas()
    for s, part in data.groupby("s"):
        b, se = explicit(part, x, ["g"], ["c"])
        got = fit[fit.s == s].set_index("term").loc[x]
        np.testing.assert_allclose(got.coef, b, rtol=1e-8)
        np.testing.assert_allclose(got.se, se, rtol=1e-8)


def test_result_is_the_same_for_any_partitioning(rows):
    fits = [linear.ols(rows.repartition(k), "y", ["x0", "x1"], "g", "c").toPandas().sort_values("term") for k in (1, 7)]
    np.testing.assert_allclose(fits[0].coef, fits[1].coef, rtol=1e-10)


def test_failures_are_reported_per_group(spark):
    pdf = pd.DataFrame({"s": ["ok"] * 8 + ["flat"] * 8 + ["tiny"], "x": list(range(8)) + [3.0] * 8 + [1.0], "z": [k % 3 for k in range(17)]})
    pdf["y"] = pdf.x * 2 + pdf.z
    fit = linear.ols(spark.createDataFrame(pdf), "y", ["x", "z"], by="s").toPandas().set_index(["s", "term"])
    assert fit.loc[("flat", "x"), "reason"] == "collinear" and pd.isna(fit.loc[("flat", "x"), "coef"])
    assert abs(fit.loc[("flat", "z"), "coef"] - 1) < 1e-9 and abs(fit.loc[("ok", "x"), "coef"] - 2) < 1e-9
    assert fit.loc[("tiny", "x"), "reason"] == "too few rows"


def test_missing_rows_are_left_out(spark, data):
    holed = data.copy()
    holed.loc[::5, "x0"] = np.nan
    fit = linear.ols(spark.createDataFrame(holed), "y", ["x0", "x1"], "g").toPandas().set_index("term")
    b, _ = explicit(holed.dropna(), ["x0", "x1"], ["g"], [])
    np.testing.assert_allclose(fit.loc[["x0", "x1"], "coef"], b, rtol=1e-8)


def test_demean(rows, data):
    got = moments.demean(rows.select("g", "y"), ["y"], "g").toPandas()
    np.testing.assert_allclose(np.sort(got.y_dm), np.sort(data.y - data.groupby("g").y.transform("mean")), atol=1e-9)


def test_large_offsets(spark):
    """Day numbers and coordinates: values far from zero with little spread."""
    rng = np.random.default_rng(2)
    x = 1e6 + rng.normal(size=(800, 13)) * 1e-2
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(13)]).assign(y=(x - 1e6) @ np.arange(1, 14) * 100)
    cols = [f"x{i}" for i in range(13)]
    for used in (cols, cols[:3]):
        fit = linear.ols(spark.createDataFrame(pdf), "y", used).toPandas().set_index("term")
        want = np.linalg.lstsq(np.column_stack([pdf[used] - 1e6, np.ones(800)]), pdf.y, rcond=None)[0]
        np.testing.assert_allclose(fit.loc[used, "coef"], want[: len(used)], rtol=1e-3)


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.0733880347707404), (1.96, 1000, 0.0502731), (0.0, 5, 1.0), (-12.706204736, 1, 0.05)])
def test_t_pvalues(t, df, p):
    assert abs(numeric.t_pvalue(t, df) - p) < 1e-6


def test_stars_and_table(rows):
    table = linear.coef_table(linear.fit_specs(rows, {"m": {"y": "y", "x": ["x0", "x13"], "absorb": "g"}}), ["m"]).toPandas()
    assert table.set_index("term").loc["x13", "m"].count("*") == 3


@pytest.mark.parametrize("delta", [1.0, 2.0])
def test_selection_bound_finds_known_delta(spark, delta):
    """No true effect; unobservables are ``delta`` times as related to the treatment as observables."""
    rng = np.random.default_rng(4)
    n = 120_000
    w, u = rng.normal(size=(n, 3)), rng.normal(size=n)
    index = w @ np.array([0.5, 0.4, 0.3])
    x = index + delta * u + rng.normal(size=n)
    y = index + u + rng.normal(size=n) * 0.5
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "w0": w[:, 0], "w1": w[:, 1], "w2": w[:, 2]}))
    found = bias.oster_delta(df, "y", "x", ["w0", "w1", "w2"], rmax=1 - 0.25 / y.var()).first()
    assert abs(found.delta - delta) < 0.06


def test_bound_with_controls_in_both_regressions(rows, data):
    found = bias.oster_delta(rows, "y", "x0", ["x1", "x2"], ["x3"], "g").first()
    short, _ = explicit(data, ["x0", "x3"], ["g"], [])
    long, _ = explicit(data, ["x0", "x3", "x1", "x2"], ["g"], [])
    np.testing.assert_allclose([found.beta_short, found.beta_long], [short[0], long[0]], rtol=1e-8)


def test_factor_index_equals_least_squares(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.integers(0, 4, 400).astype(str), "b": rng.integers(0, 3, 400), "y": rng.normal(size=400)})
    got = fill.feature_index(spark.createDataFrame(pdf), "y", ["a", "b"]).toPandas()
    x = pd.get_dummies(got[["a", "b"]].astype(str)).to_numpy(float)
    np.testing.assert_allclose(got["index"], x @ np.linalg.lstsq(x, got.y, rcond=None)[0], atol=1e-9)
    holed = spark.createDataFrame(pdf).withColumn("a", F.when(F.col("a") != "2", F.col("a")))
    assert fill.feature_index(holed, "y", ["a", "b"]).filter("a is null and index is not null").count() == 0


def test_imputation(spark):
    rng = np.random.default_rng(9)
    x, z = rng.normal(size=900), rng.normal(size=900)
    y = 2 * x + 1
    pdf = pd.DataFrame({"x": x, "z": z, "y": np.where(np.arange(900) % 4 == 0, np.nan, y)})
    df = spark.createDataFrame(pdf).withColumn("y", F.nullif("y", F.lit(float("nan"))))
    chosen, _ = fill.predictor_screen(df, ["y"], ["x", "z"])
    assert chosen == {"y": ["x"]}
    got = fill.impute_linear(df, ["y"], ["x", "z"]).toPandas().sort_values("x")
    np.testing.assert_allclose(got.y, 2 * got.x + 1, atol=1e-9)


def test_imputation_without_predictors_takes_the_mean(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 1.0), (None, 2.0)], "y double, x double")
    assert fill.impute_linear(df, ["y"], ["x"], mincor=1.1).filter("x = 2").first().y == 2.0


def test_a_chain_of_imputations_equals_fits_row_by_row(spark, monkeypatch):
    """Many patterns of missing values; every step uses the predictions before it. Rows are summed once."""
    rng = np.random.default_rng(10)
    n, names = 1200, ["a", "b", "c", "d", "e"]
    base = rng.normal(size=(n, 2))
    x = base @ rng.normal(size=(2, 5)) + 0.3 * rng.normal(size=(n, 5)) + np.array([1e5, 5, -3, 0, 2000])
    x[rng.random((n, 5)) < 0.25] = np.nan
    pdf = pd.DataFrame(x, columns=names)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).withColumn("id", F.monotonically_increasing_id()).repartition(5)
    calls = []
    whole = fill.batch_products
    monkeypatch.setattr(fill, "batch_products", lambda *a: calls.append(1) or whole(*a))
    got = fill.impute_linear(df, ["a", "b", "c"], names).orderBy("id").toPandas()
    assert len(calls) == 1
    chosen, _ = fill.predictor_screen(df, ["a", "b", "c"], names)
    filled = pdf.fillna(pdf.mean())
    for t, used in chosen.items():
        have = pdf[t].notna().to_numpy()
        full = np.column_stack([np.ones(n), filled[used]])
        b = np.linalg.lstsq(full[have] - np.r_[0, full[have, 1:].mean(0)], pdf[t][have], rcond=None)[0]
        guess = (full - np.r_[0, full[have, 1:].mean(0)]) @ b
        filled[t] = np.where(have, pdf[t], guess)
    order = df.orderBy("id").select(*names).toPandas().astype(float)
    key = lambda f: f.reset_index(drop=True)
    np.testing.assert_allclose(key(order).isna().sum(), pdf.isna().sum())
    for t in ("a", "b", "c"):
        np.testing.assert_allclose(np.sort(got[t]), np.sort(filled[t]), rtol=1e-8)
    assert got[["d", "e"]].isna().sum().tolist() == pdf[["d", "e"]].isna().sum().tolist()


def test_screen_equals_pairwise_correlations(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4))
    x[rng.random((500, 4)) < 0.3] = np.nan
    x[:, 0] = np.where(x[:, 1] > 0.5, np.nan, x[:, 0])
    pdf = pd.DataFrame(x, columns=list("abcd"))
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for mincor in (0.1, 0.3, 0.5):
        chosen, means = fill.predictor_screen(df, ["a", "c"], list("abcd"), mincor)
        for t in ("a", "c"):
            gone = pdf[t].isna()
            want = [c for c in "abcd" if c != t and max(abs(pdf[t].corr(pdf[c])), abs(gone.astype(float).corr(pdf[c]))) >= mincor
                    and pdf[c][gone].notna().mean() >= 0.1]
            assert chosen[t] == want
        np.testing.assert_allclose([means[c] for c in "abcd"], pdf.mean())


def test_spline_basis_sums_to_one():
    b = additive.spline_basis(np.linspace(-2, 5, 101), -2, 5, 9)
    np.testing.assert_allclose(b.sum(1), 1)
    assert b.min() >= 0


def test_additive_model_recovers_linear_effect(spark):
    rng = np.random.default_rng(10)
    n = 4000
    t, x, u, w = rng.integers(0, 2, n), rng.uniform(0, 6, n), rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    y = 0.3 * t + np.sin(x) + np.sin(3 * u) * w + rng.normal(size=n) * 0.2
    df = spark.createDataFrame(pd.DataFrame({"t": t, "x": x, "u": u, "w": w, "y": y, "k": np.zeros(n)}))
    fit = additive.additive_ols(df, "y", ["t", "k"], ["x"], [("u", "w")]).toPandas().set_index("term")
    assert abs(fit.loc["t", "coef"] - 0.3) < 3 * fit.loc["t", "se"] and fit.loc["t", "se"] < 0.01
    assert fit.loc["s(x)", "edf"] > 4 and fit.loc["t", "r2"] > 0.9
    assert fit.loc["k", "reason"] == "constant"


def test_screening(rows, data):
    got = screening.trait_screen(rows, "y", ["x0", "x1"]).toPandas().set_index("trait")
    for c in ("x0", "x1"):
        assert abs(got.loc[c, "coef"] - np.polyfit(data[c], data.y, 1)[0]) < 1e-9
    r = screening.correlation(rows, "x0", "y").first()
    assert abs(r.r - np.corrcoef(data.x0, data.y)[0, 1]) < 1e-9 and 0 <= r.p <= 1


@pytest.mark.parametrize("width", [2, 13])
@pytest.mark.parametrize("cluster", [None, "c"])
@pytest.mark.parametrize("value", ["1", "0.1 + g"])
def test_column_constant_within_effect_is_collinear_on_many_partitions(spark, width, cluster, value):
    # 49 rows of a cell in each partition: 1 / 49 * 49 is not 1 in doubles, so that means err in their last digit.
    rows = spark.range(0, 49 * 6 * 8, 1, 8).selectExpr("id % 3 AS g", "id % 2 AS s", "id % 5 AS c", "sin(id * id) AS y", *[f"cos(id * {k + 2}) AS x{k}" for k in range(width)])
    rows = rows.withColumn("x0", F.when(F.col("s") == 0, F.expr(value)).otherwise(F.col("x0")))
    fit = linear.ols(rows, "y", [f"x{k}" for k in range(width)], "g", cluster, by="s").toPandas().set_index(["s", "term"])
    assert fit.loc[(0, "x0")].reason == "collinear" and np.isnan(fit.loc[(0, "x0")].coef)
    assert fit.drop(index=(0, "x0")).reason.isna().all()
