"""Binned fits, tests and curves of smooths."""

import numpy as np
import pandas as pd
import pytest

from plotmark.models import additive, numeric

ARGS = ("y", ["t"], ["x"], [("u", "w")])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(31)
    n = 3000
    pdf = pd.DataFrame({"t": rng.integers(0, 2, n), "x": rng.uniform(-2, 6, n), "u": rng.uniform(0, 1, n), "w": rng.uniform(5, 9, n)})
    pdf["y"] = 40 + 0.3 * pdf.t + np.sin(pdf.x) + pdf.u * (pdf.w - 7) + rng.normal(size=n) * 0.2
    return pdf.assign(g=np.where(np.arange(n) % 3, "a", "b"))


def rounded(pdf, c, bins):
    lo, hi = pdf[c].min(), pdf[c].max()
    return lo + np.floor((pdf[c] - lo) / (hi - lo) * (bins - 1) + 0.5) / (bins - 1) * (hi - lo)


def test_binned_fit_equals_row_fit_of_binned_data(spark, data):
    coarse = pd.concat(
        [d.assign(x=rounded(d, "x", 60), u=rounded(d, "u", 12), w=rounded(d, "w", 12)) for _, d in data.groupby("g")]
    )
    sort = ["g", "term"]
    binned = additive.additive_ols(spark.createDataFrame(data), *ARGS, by="g", bins=60, bins2d=12).toPandas()
    slow = additive.additive_ols(spark.createDataFrame(coarse), *ARGS, by="g").toPandas()
    pd.testing.assert_frame_equal(binned.sort_values(sort, ignore_index=True), slow.sort_values(sort, ignore_index=True), rtol=1e-5)
    assert binned.groupby("g").size().to_dict() == {"a": 3, "b": 3}


def test_binned_fit_leaves_no_python_on_rows(spark, data):
    model = additive._Model(spark.createDataFrame(data), *ARGS, None, 10, 5, 60, 12)
    plan = model.cross._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan and "Join" not in plan.split("Aggregate")[0]
    assert plan.count("FlatMapGroupsInPandas") == 2


def test_missing_values_constants_and_empty_tables(spark, data):
    rows = spark.createDataFrame(data.assign(x=1.5, g=None).astype({"g": object}), "t long, x double, u double, w double, y double, g string")
    flat = additive.additive_ols(rows, "y", ["t"], ["x"], bins=50).toPandas().set_index("term")
    assert flat.loc["t", "coef"] == flat.loc["t", "coef"] and abs(flat.loc["s(x)", "edf"]) < 1e-3
    assert additive.additive_ols(rows, *ARGS, by="g", bins=50).count() == 0
    assert additive.additive_ols(rows.limit(0), *ARGS, bins=50).count() == 0
    assert additive.additive_curves(rows.limit(0), *ARGS, bins=50).count() == 0
    holes = spark.createDataFrame(data.assign(x=data.x.where(data.index % 5 > 0)))
    assert {r.n for r in additive.additive_ols(holes, *ARGS, bins=50).collect()} == {2400}
    few = additive.additive_ols(rows.limit(1), *ARGS, bins=50).collect()
    assert [r.reason for r in few] == ["too few rows"]


def test_smooth_tests(spark, data):
    null = data.assign(z=np.random.default_rng(2).uniform(size=len(data)))
    fit = additive.additive_ols(spark.createDataFrame(null), "y", ["t"], ["x", "z"], [("u", "w")], bins=80).toPandas().set_index("term")
    assert fit.loc["s(x)", "p"] < 1e-10 and fit.loc["s(u,w)", "p"] < 1e-10 and fit.loc["s(z)", "p"] > 0.01
    for f, a, b, p in ((1.0, 1, 10, 0.340893), (3.0, 4, 20, 0.625**10 * 4.75), (0.0, 3, 9, 1.0)):
        assert abs(numeric.f_pvalue(f, a, b) - p) < 1e-5


@pytest.mark.parametrize("penalty", [None, 1.0])
def test_null_terms_are_rejected_at_the_stated_rate(penalty):
    rng = np.random.default_rng(7)
    terms = additive._terms(1, ["x", "z"], [], 10, 5)
    p = []
    for _ in range(600):
        x, z = rng.uniform(size=(2, 300))
        y = np.sin(5 * x) + rng.normal(size=300)
        full = np.hstack([np.ones((300, 1)), terms[0].basis([x]), terms[1].basis([z]), y[:, None]])
        p.append(additive._Fit(full.T @ full, terms, penalty).smooth_p(terms[1]))
    share = np.mean(np.array(p) < 0.05)
    assert 0.025 < share < 0.085, share


def test_curves_follow_the_truth(spark, data):
    curves = additive.additive_curves(spark.createDataFrame(data), *ARGS, bins=100, points=15).toPandas()
    x = curves[curves.term == "s(x)"]
    truth = np.sin(x.x) - np.sin(data.x).mean()
    assert len(x) == 15 and x.x2.isna().all() and x.x.min() == data.x.min() and x.x.max() == data.x.max()
    assert np.abs(x.fit - truth).max() < 0.1 and ((x.lo <= truth) & (truth <= x.hi)).mean() >= 0.7
    plane = curves[curves.term == "s(u,w)"]
    truth = plane.x * (plane.x2 - 7) - (data.u * (data.w - 7)).mean()
    assert len(plane) == 225 and np.abs(plane.fit - truth).max() < 0.25
