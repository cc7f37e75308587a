"""Analysis table and effect estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plotmark.functions.scalars import SALES_FROM_DAY, blockgroup_id, date_from_day, month_index
from plotmark.models.additive import additive_curves, additive_ols
from plotmark.models.fill import feature_index
from plotmark.models.linear import fit_specs, ols
from plotmark.models.moments import demean
from plotmark.models.screening import correlation, fitted_line
from plotmark.operators.areas import group_size
from plotmark.operators.summaries import interact, levels_of, one_hot, standardise
from plotmark.session import materialize
from plotmark.sources.contracts import lookup

# House age classes and the size of a large subdivision.
OLD_AGE, YOUNG_AGE, LARGE_SUBDIVISION = 14, 5, 50


def regression_base(
    transactions: DataFrame,
    parcels: DataFrame,
    covariates: Sequence[tuple[DataFrame, str]],
    factors: Sequence[str] = ("bdrms", "baths", "totrms", "topography", "extwall"),
) -> DataFrame:
    """Sales with mortgage since the start day, with area covariates and dummies."""
    sales = transactions.filter((F.col("DocumentDate") >= SALES_FROM_DAY) & (F.col("DataClassStndCode") == "H"))
    place = parcels.select(
        "RowID", blockgroup_id("PropertyAddressCensusTractAndBlock").alias("geoid"), "LegalSubdivisionName"
    )
    df = sales.join(place, "RowID", "left")
    status = F.when(F.col("hoa_neigh").isin(0, 1), F.col("hoa_neigh"))
    df = df.withColumns(
        {
            "HOA": F.col("hoa"),
            "HOA_NEIGH": status,
            "foreclosure": F.when(F.col("deed_type") == "foreclosure", 1).otherwise(0),
            "warranty": F.when(F.col("deed_type") == "warranty", 1).otherwise(0),
            "month": month_index(date_from_day("DocumentDate")),
            "SS": F.substring("FIPS", 1, 2),
        }
    )
    # Written, as group sizes, levels and the result all read it and it is the end of many joins.
    df = materialize(df, "sales")
    found = {factor: levels_of(df, factor) for factor in factors}
    df = group_size(df, ["FIPS", "LegalSubdivisionName"], "subdiv_size", no_name=["NA", ""])
    for table, key in covariates:
        df = lookup(df, table, key)
    for factor in factors:
        df = one_hot(df, factor, found[factor], drop_first=True)
    return df


def interaction_models(df: DataFrame, y: str, treat: str, controls: Sequence[str], absorb: Sequence[str], cluster: str) -> DataFrame:
    """The effect with one interaction at a time (R9): age, size and tax traits of the house."""
    age = F.col("ageAtSale")
    df = standardise(df, ["tax_rate", "lba", "llota"])
    df = df.withColumns(
        {
            "age14plus": (age >= OLD_AGE).cast("int"),
            "age5under": (age < YOUNG_AGE).cast("int"),
            "subdiv_50plus": (F.col("subdiv_size") >= LARGE_SUBDIVISION).cast("int"),
        }
    )
    traits = ["ageAtSale", "age14plus", "age5under", "z_lba", "z_llota", "z_tax_rate", "subdiv_size", "subdiv_50plus"]
    df = interact(df, treat, traits)
    spec = {"y": y, "absorb": absorb, "cluster": cluster}
    return fit_specs(df, {t: {**spec, "x": [treat, f"{treat}_x_{t}", *controls]} for t in traits})


def national_models(df: DataFrame, y: str, controls: Sequence[str], tract: str, month: str, cluster: str) -> DataFrame:
    """Both treatments under a tract effect with month dummies, and under a tract-by-month effect."""
    specs = {}
    for n, treat in enumerate(("HOA", "HOA_NEIGH")):
        where = None if treat == "HOA" else F.col(treat).isin(0, 1)
        shared = {"y": y, "x": [treat, *controls], "cluster": cluster, "where": where}
        specs[f"main{2 * n + 1}"] = {**shared, "absorb": [tract], "factors": [month]}
        specs[f"main{2 * n + 2}"] = {**shared, "absorb": [tract, month]}
    return fit_specs(df, specs)


def group_premium(
    df: DataFrame,
    group: str,
    y: str,
    treat: str,
    controls: Sequence[str],
    absorb: Sequence[str] | str,
    cluster: str | None = None,
    regions: DataFrame | None = None,
) -> DataFrame:
    """One row per group: observations, effect with bounds, treated share, region."""
    fits = ols(df, y, [treat, *controls], absorb, cluster, by=group).filter(F.col("term") == treat)
    fits = fits.select(group, F.col("coef").alias("beta"), "se", F.col("lo").alias("lb"), F.col("hi").alias("ub"), "n", "reason")
    shares = df.dropna(subset=[group]).groupBy(group).agg(F.count("*").alias("obs"), F.avg(treat).alias("share"))
    out = shares.join(fits, group, "left")
    return lookup(out, regions, group) if regions is not None else out


def premium_relation(premiums: DataFrame, trait: str, min_obs: int = 1000, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Correlation of the group effects with a trait, and the fitted line."""
    enough = premiums.filter(F.col("obs") >= min_obs)
    return correlation(enough, "beta", trait), fitted_line(enough, "beta", trait, [region] if region else ())


def additive_effect(
    df: DataFrame,
    y: str,
    treat: str,
    factors: Sequence[str],
    continuous: Sequence[str],
    raw_smooths: Sequence[str],
    place: tuple[str, str],
    effect: str,
    by: str | None = None,
    where: Column | None = None,
    bins: int | None = None,
    curves: bool = False,
) -> DataFrame:
    """Additive fit of a factor index and demeaned traits, nationally or per group.

    With ``bins``, columns of smooths are rounded to that many points of their range. With ``curves``,
    the evaluated smooths come in place of the table of terms.
    """
    df = df if where is None else df.filter(where)
    indexed = feature_index(df, y, factors, by, "index")
    keys = [by, effect] if by else [effect]
    within = demean(indexed, ["index", y, *continuous], keys)
    smooths = ["index_dm", *[f"{c}_dm" for c in continuous], *raw_smooths]
    made = additive_curves if curves else additive_ols
    return made(within, f"{y}_dm", [treat], smooths, [place], by, bins=bins)


def results_rows(fits: DataFrame, regtype: str, group: str | None, term: str) -> DataFrame:
    """Rows of the common results table (K4, K7): regtype, group, term, coef, se, n."""
    who = F.col(group).cast("string") if group else F.lit(None).cast("string")
    return fits.filter(F.col("term") == term).select(
        F.lit(regtype).alias("regtype"), who.alias("group"), "term", "coef", "se", "n"
    )
