"""Analyses of effects on simulated sales with known truths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotmark.models.additive import additive_ols
from plotmark.plans import effects


@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.default_rng(21)
    n = 3000
    tract, month = rng.integers(0, 30, n), rng.integers(540, 546, n)
    hoa, age = rng.integers(0, 2, n), rng.integers(0, 40, n).astype(float)
    lba, llota, tax = rng.normal(7, 0.3, n), rng.normal(9, 0.5, n), rng.uniform(0, 0.1, n)
    y = 0.1 * hoa - 0.004 * hoa * age + 0.5 * lba + tract * 0.05 + rng.normal(0, 0.05, n)
    pdf = pd.DataFrame(dict(lprice=y, HOA=hoa, ageAtSale=age, lba=lba, llota=llota, tax_rate=tax, tract=tract, month=month))
    pdf = pdf.assign(FIPS=tract // 3, subdiv_size=rng.integers(1, 100, n), HOA_NEIGH=np.where(rng.uniform(size=n) < 0.9, hoa, np.nan), metro=tract % 4)
    df = spark.createDataFrame(pdf)
    return df.withColumn("HOA_NEIGH", F.nullif("HOA_NEIGH", F.lit(float("nan"))).cast("int"))


def test_interactions(sales):
    fits = effects.interaction_models(sales, "lprice", "HOA", ["lba", "ageAtSale"], ["tract"], "FIPS").toPandas()
    assert fits.model.nunique() == 8
    slope = fits[(fits.model == "ageAtSale") & (fits.term == "HOA_x_ageAtSale")].iloc[0]
    assert abs(slope.coef + 0.004) < 4 * slope.se < 0.01


def test_national_models(sales):
    fits = effects.national_models(sales, "lprice", ["lba"], "tract", "month", "FIPS").toPandas()
    n = fits.groupby("model").n.first()
    groups = fits.groupby("model")["groups"].first()
    assert set(n.index) == {"main1", "main2", "main3", "main4"}
    assert n["main1"] == 3000 and n["main3"] < 2900 and groups["main2"] > groups["main1"] == 30


def test_group_premium_and_relation(sales):
    found = effects.group_premium(sales, "metro", "lprice", "HOA", ["lba", "ageAtSale"], ["tract"], "FIPS")
    rows = found.toPandas()
    assert len(rows) == 4 and ((rows.lb < rows.beta) & (rows.beta < rows.ub)).all() and rows.obs.sum() == 3000
    r, line = effects.premium_relation(found, "share", 100)
    assert r.first().n == 4 and line.count() == 1


def test_additive_effect_by_group(sales):
    # Age is left out of the treatment's slope, so the effect is that at the mean age.
    typed = sales.withColumn("kind", (F.col("subdiv_size") % 3).cast("string"))
    fit = effects.additive_effect(
        typed, "lprice", "HOA", ["kind"], ["lba", "tax_rate"], ["ageAtSale"], ("llota", "subdiv_size"), "tract", by="metro"
    )
    got = fit.filter("kind = 'linear'").toPandas()
    assert len(got) == 4 and (abs(got.coef - (0.1 - 0.004 * 19.5)) < 0.03).all()


def test_additive_fit_does_not_depend_on_other_groups(spark):
    """Groups on ranges far apart are fitted as if each were alone."""
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 1, 1500)
    k = np.arange(1500) % 5
    y = np.sin(6 * x) + 0.05 * rng.normal(size=1500)
    df = spark.createDataFrame(pd.DataFrame({"k": k, "x": x + 100.0 * k, "t": rng.normal(size=1500), "y": y}))
    together = additive_ols(df, "y", ["t"], ["x"], by="k").filter("k = 3").toPandas()
    alone = additive_ols(df.filter("k = 3"), "y", ["t"], ["x"]).toPandas()
    for c in ("coef", "edf", "r2"):
        np.testing.assert_allclose(together[c].astype(float), alone[c].astype(float), rtol=1e-6)
    assert together.r2.min() > 0.95 and together.edf.max() > 4


def test_results_rows(sales):
    from plotmark.models.linear import ols

    rows = effects.results_rows(ols(sales, "lprice", ["HOA"], by="metro"), "hoa_ols", "metro", "HOA").collect()
    assert len(rows) == 4 and rows[0].regtype == "hoa_ols"
