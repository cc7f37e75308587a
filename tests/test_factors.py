"""Fits with factors equal the dense path with explicit dummies."""

import numpy as np
import pandas as pd
import pytest

from plotmark.models import factors, linear


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 2000
    g, m, k, c = rng.integers(0, 40, n), rng.integers(1, 15, n), rng.integers(0, 6, n), rng.integers(0, 15, n)
    pdf = pd.DataFrame({"g": g, "m": m, "k": [f"k{v}" for v in k], "c": c, "s": np.where(c < 8, "a", "b")})
    pdf["x1"] = rng.normal(size=n) + 0.1 * g + 0.2 * m
    pdf["x2"] = (rng.random(n) < 0.4).astype(int)
    pdf["y"] = 1000 + 2 * pdf.x1 - pdf.x2 + np.sin(g) + 0.3 * m + 0.5 * k + rng.normal(size=n) * (1 + 0.1 * c)
    pdf.loc[::97, "x1"] = np.nan
    pdf.loc[::89, "m"] = pd.NA
    pdf["m"] = pdf.m.astype("Int64")
    return pdf


@pytest.fixture(scope="module")
def rows(spark, data):
    records = [tuple(None if pd.isna(v) else v for v in r) for r in data.astype(object).itertuples(index=False)]
    kinds = "g long, m long, k string, c long, s string, x1 double, x2 long, y double"
    return spark.createDataFrame(records, kinds).repartition(5)


def explicit(pdf, effects, cluster):
    pdf = pdf.dropna(subset=["x1", *[c for e in effects for c in e]])
    dummies = [pd.get_dummies(pdf[e].astype(str).agg("|".join, axis=1)).to_numpy(float)[:, (i > 0) :] for i, e in enumerate(effects)]
    full = np.hstack([pdf[["x1", "x2"]].to_numpy(float), *dummies])
    y = pdf.y.to_numpy()
    inv = np.linalg.pinv(full.T @ full)
    beta = inv @ full.T @ y
    u, n, k = y - full @ beta, len(pdf), np.linalg.matrix_rank(full)
    if not cluster:
        v = inv * (u @ u) / (n - k)
    else:
        scores = np.array([full[i].T @ u[i] for i in pdf.groupby(cluster).indices.values()])
        v = inv @ scores.T @ scores @ inv * len(scores) / (len(scores) - 1) * (n - 1) / (n - k)
    return beta[:2], np.sqrt(np.diag(v))[:2], n - k


CASES = [
    (["m"], ["g"], ["c"]), (["m"], ["g"], []), (["m", "k"], ["g"], ["c"]), (["m", "k"], [], []), (["g"], [], ["c", "s"]), (["k"], ["g", "s"], ["c"]),
]


@pytest.mark.parametrize("used,absorb,cluster", CASES)
def test_equals_dummies(rows, data, used, absorb, cluster):
    fit = factors.factor_ols(rows, "y", ["x1", "x2"], used, absorb or None, cluster or None).toPandas().set_index("term").loc[["x1", "x2"]]
    b, se, df = explicit(data, [[f] for f in used] + ([absorb] if absorb else []), cluster)
    np.testing.assert_allclose(fit.coef, b, rtol=1e-7)
    np.testing.assert_allclose(fit.se, se, rtol=1e-6)
    assert set(fit.df_resid) == {df}


def test_by_group(rows, data):
    fit = factors.factor_ols(rows, "y", ["x1", "x2"], ["m"], "g", "c", by="s").toPandas()
    for s, part in data.groupby("s"):
        b, se, _ = explicit(part, [["m"], ["g"]], ["c"])
        got = fit[fit.s == s].set_index("term").loc[["x1", "x2"]]
        np.testing.assert_allclose(got.coef, b, rtol=1e-7)
        np.testing.assert_allclose(got.se, se, rtol=1e-6)


def test_small_tables_of_levels_change_nothing(rows, monkeypatch):
    want = factors.factor_ols(rows, "y", ["x1", "x2"], ["m", "k"], "g").toPandas().sort_values("term")
    monkeypatch.setattr(factors, "FLUSH_LEVELS", 3)
    got = factors.factor_ols(rows.repartition(2), "y", ["x1", "x2"], ["m", "k"], "g").toPandas().sort_values("term")
    np.testing.assert_allclose(got.coef, want.coef, rtol=1e-9)


def test_terms_that_factors_explain_are_reported(rows):
    fit = factors.factor_ols(rows.withColumn("z", rows["m"] * 2.0), "y", ["x1", "z"], ["m"], "g").toPandas().set_index("term")
    assert fit.loc["z", "reason"] == "collinear" and fit.loc["x1", "coef"] > 1


def test_five_thousand_levels(spark):
    """Both a factor and an absorbed effect with thousands of levels, beyond any table of dummies."""
    n = 60_000
    df = spark.range(n).selectExpr(
        "id % 5000 AS f", "id % 120 AS m", "cast(hash(id) % 1000 AS double) / 1000 AS x1",
        "cast(hash(id) % 1000 AS double) / 500 + id % 5000 + (id % 120) * 0.5 AS y", "id % 2 AS x2",
    )
    fit = factors.factor_ols(df, "y", ["x1"], ["f", "m"]).first()
    assert abs(fit.coef - 2) < 1e-6 and fit.groups == 5000
    index = factors.factor_index(df, "y", ["f", "m"])
    off = index.selectExpr("max(abs(index - y)) AS d").first().d
    assert off < 4.1 and index.count() == n


def test_index_equals_dense_fit(rows, data):
    got = factors.factor_index(rows, "y", ["m", "k", "g"], name="fitted").toPandas()
    assert got[got.m.isna()].fitted.isna().all()
    used = data.dropna(subset=["m"])
    full = np.hstack([pd.get_dummies(used[f].astype(str)).to_numpy(float)[:, (f != "m") :] for f in ("m", "k", "g")])
    fitted = full @ (np.linalg.pinv(full) @ used.y.to_numpy())
    want = used.assign(fitted=fitted).groupby(["m", "k", "g"]).fitted.first()
    have = got.dropna(subset=["fitted"]).groupby(["m", "k", "g"]).fitted.first()
    assert len(have) == len(want)
    np.testing.assert_allclose(have.sort_index(), want.sort_index(), rtol=1e-8)


def test_plan_has_no_dummies(rows):
    plan = factors.factor_ols(rows, "y", ["x1"], ["m"], "g")._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN" not in plan


def test_one_numeric_column_and_one_factor_is_absorption(rows):
    one = factors.factor_ols(rows, "y", ["x1"], ["g"]).first()
    two = linear.ols(rows.dropna(subset=["g"]), "y", ["x1"], "g").first()
    assert abs(one.coef - two.coef) < 1e-9 and abs(one.se - two.se) < 1e-9


SETS = {"one": ["x1"], "two": ["x1", "x2"], "three": ["x2", "z", "x1"]}


@pytest.mark.parametrize("cluster,by,absorb", [("c", None, "g"), (None, "s", "g"), ("c", "s", ["g", "k"]), ("c", None, None)])
def test_models_on_the_same_rows_share_their_moments(rows, monkeypatch, cluster, by, absorb):
    df = rows.dropna(subset=["x1"]).withColumn("z", rows["x1"] * rows["x2"])
    specs = {n: {"y": "y", "x": x, "absorb": absorb, "cluster": cluster, "by": by} for n, x in SETS.items()}
    calls = []
    whole = linear._fit_superset
    monkeypatch.setattr(linear, "_fit_superset", lambda *a: calls.append(a[2]) or whole(*a))
    keys = ["model", "term", *([by] if by else [])]
    got = linear.fit_specs(df, specs).toPandas().set_index(keys).sort_index()
    assert calls == [SETS]
    for name, spec in specs.items():
        want = linear.ols(df, **spec).withColumn("model", factors.F.lit(name)).toPandas().set_index(keys).sort_index()
        mine = got.loc[[name]]
        assert list(mine.index) == list(want.index)
        for column in ("coef", "se", "p", "df_resid", "r2_within"):
            np.testing.assert_allclose(mine[column].astype(float), want[column].astype(float), rtol=1e-6, atol=1e-9)


def test_models_with_other_missing_rows_are_fitted_alone(rows):
    specs = {"full": {"y": "y", "x": ["x2"]}, "holes": {"y": "y", "x": ["x2", "x1"]}}
    n = {r.model: r.n for r in linear.fit_specs(rows, specs).collect()}
    assert n["full"] == 2000 > n["holes"]


def test_column_constant_within_largest_effect_is_collinear(spark):
    rows = spark.range(0, 49 * 40, 1, 40).selectExpr("id % 30 AS g", "id % 7 AS m", "1000.3 + id % 30 / 7 AS x1", "cos(id * 3) AS x2", "sin(id * id) AS y")
    fit = factors.factor_ols(rows, "y", ["x1", "x2"], ["m"], "g").toPandas().set_index("term")
    assert fit.reason["x1"] == "collinear" and fit.reason.isna()["x2"]


@pytest.mark.parametrize("dense", [0, 1e9])
def test_shares_of_pairs(monkeypatch, dense):
    monkeypatch.setattr(factors, "DENSE", dense)
    monkeypatch.setattr(factors, "PAIRS", 7)
    rng = np.random.default_rng(1)
    group = np.sort(rng.integers(0, 9, 40))
    level = np.concatenate([rng.permutation(12)[: (group == g).sum()] for g in np.unique(group)])
    n, size = rng.integers(1, 9, 40).astype(float), 50.0 + group
    want = np.zeros((12, 12))
    for g in np.unique(group):
        at = group == g
        want[np.ix_(level[at], level[at])] += np.outer(n[at], n[at]) / (50.0 + g)
    np.testing.assert_allclose(factors._shares(group, level, 12, n, size), want)


@pytest.mark.parametrize("flush", [3, 2000])
def test_pair_shares_by_key_and_in_small_frames(spark, monkeypatch, flush):
    monkeypatch.setattr(factors, "FLUSH_LEVELS", flush)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rows = [(k % 3, k // 12, f"1:{k % 4}", f"2:{k * k % 5}", 1 + k % 6) for k in range(150)]
    cells = spark.createDataFrame(rows, "b int, g int, e1 string, e2 string, n long")
    got = {(r.b, r.i, r.j): r.s for r in factors._pair_shares(cells, ["b"], ["g"], ["e1", "e2"]).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict = {}
    for b, g in {r[:2] for r in rows}:
        counts: dict = {}
        for r in rows:
            if r[:2] == (b, g):
                for level in r[2:4]:
                    counts[level] = counts.get(level, 0) + r[4]
        size = sum(r[4] for r in rows if r[:2] == (b, g))
        for i in counts:
            for j in counts:
                if i <= j:
                    want[b, i, j] = want.get((b, i, j), 0) + counts[i] * counts[j] / size
    assert got == pytest.approx(want)


def test_products_of_few_columns_need_no_scan_of_rows(rows):
    cells = factors._Cells(rows, "y", ["x1", "x2"], ["m"], ["g"], ["c"], [])
    assert not set(cells.products().inputFiles()) & set(cells.work.inputFiles())
