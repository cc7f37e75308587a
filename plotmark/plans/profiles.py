"""Descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plotmark.functions.scalars import (
    SALES_FROM_DAY,
    blockgroup_from_gisjoin,
    blockgroup_id,
    gisjoin_county,
    percent,
)
from plotmark.operators.areas import area_rates, qualified_groups, usable_columns
from plotmark.operators.records import first_per_key
from plotmark.operators.skew import attach_groups
from plotmark.operators.summaries import exposure_matrix, stacked_means, weighted_mean
from plotmark.plans import codes
from plotmark.sources.contracts import lookup

SHOWN_YEARS = (1940, 2015)
NEW_YEARS = (2000, 2015)
MODE_WIDTH = 5
LOGGED = ["lprice", "llota", "lba", "lgara", "loba"]


def _new_neighbourhood():
    """Status 0/1 of houses built within five years of their subdivision's modal year."""
    near = (F.col("YearBuilt") - F.col("YearBuilt_mode")).between(-MODE_WIDTH, MODE_WIDTH)
    return F.when(near & F.col("hoa_neigh").isin(0, 1), F.col("hoa_neigh"))


def with_geography(parcels: DataFrame, clusters: DataFrame, abbreviations: DataFrame, metros: DataFrame, divisions: DataFrame) -> DataFrame:
    """Parcels with inferred status, postal code, metro and census division."""
    county = metros.select(F.concat("fipsstatecode", "fipscountycode").alias("county"), "cbsacode")
    division = divisions.select(F.substring("state_code", 2, 10).alias("state"), "division_code")
    df = parcels.join(clusters, "RowID", "left")
    return lookup(lookup(lookup(df, abbreviations, "state"), county, "county"), division, "state")


def status_trend(parcels: DataFrame) -> DataFrame:
    """Flagged share by year built: all houses, and houses of new subdivisions."""
    shown = parcels.filter(F.col("YearBuilt").between(*SHOWN_YEARS))
    both = shown.groupBy("YearBuilt").agg(
        F.avg("hoa").alias("all_houses"), F.avg(_new_neighbourhood()).alias("new_subdivisions")
    )
    return both.dropna().orderBy("YearBuilt")


def rates_by_area(parcels: DataFrame, levels: Sequence[str] = ("cbsacode", "county", "division_code")) -> DataFrame:
    """Flagged share by metro, county and division, of all and of new houses.

    The new rate of a metro is that of its recent houses; elsewhere it is the status of
    recent houses in new subdivisions. Division rates are whole percents.
    """
    recent = F.col("YearBuilt").between(*NEW_YEARS)
    rates = area_rates(
        parcels,
        levels,
        {
            "hoa_pct": F.col("hoa"),
            "_recent": F.when(recent, F.col("hoa")),
            "_subdivision": F.when(recent, _new_neighbourhood()),
        },
    )
    new = F.when(F.col("level") == "cbsacode", F.col("_recent")).otherwise(F.col("_subdivision"))
    whole = F.col("level") == "division_code"

    def shown(c):
        return F.when(whole, percent(c)).otherwise(c)

    return rates.filter("hoa_pct is not null").select(
        "level",
        "area",
        F.when(F.col("level") == "county", gisjoin_county("area")).alias("gisjoin"),
        shown(F.col("hoa_pct")).alias("hoa_pct"),
        shown(new).alias("hoa_pct_new"),
    )


def census_weighted_profile(parcels: DataFrame, census: DataFrame, groups: Sequence[str], income: str = "med_hs_income", min_n: int = 30) -> tuple[DataFrame, DataFrame]:
    """Group shares and income of flagged and other residents, and the exposure table."""
    areas = (
        parcels.withColumn("geoid", blockgroup_id("PropertyAddressCensusTractAndBlock"))
        .dropna(subset=["geoid"])
        .groupBy("geoid")
        .agg(F.avg("hoa").alias("hoa_geoid"), F.count("RowID").alias("records_n"))
        .filter((F.col("records_n") >= min_n) & F.col("hoa_geoid").isNotNull())
    )
    shares = {g: f"{g}_geoid" for g in groups}
    people = census.filter("total_pop > 0").withColumns(
        {"geoid": blockgroup_from_gisjoin("GISJOIN"), **{s: F.col(g) / F.col("total_pop") for g, s in shares.items()}}
    )
    joined = areas.join(people, "geoid")
    flagged, other = F.col("hoa_geoid"), 1 - F.col("hoa_geoid")
    columns = [*shares.values(), income]
    profile = None
    for name, part in (("hoa", flagged), ("nonhoa", other)):
        row = weighted_mean(joined, columns, F.col("total_pop") * part).withColumn("weight", F.lit(name))
        profile = row if profile is None else profile.unionByName(row)
    exposure = exposure_matrix(joined, {g: g for g in groups}, shares, {"hoa": flagged, "nonhoa": other})
    return profile, exposure


def group_summary_table(
    parcels: DataFrame, transactions: DataFrame, columns: Sequence[str], sequence: str = "TransId"
) -> tuple[DataFrame, DataFrame]:
    """Property means under four groupings, and rows left at each stage.

    A parcel counts with its first transaction by ``sequence``.
    """
    own = ["hoa", "hoa_neigh", "YearBuilt"]
    sold = first_per_key(transactions.drop(*own, *[c for c in parcels.columns if c != "RowID"]), "RowID", [sequence])
    df = parcels.join(sold.withColumns({c: F.exp(c) for c in LOGGED if c in sold.columns}), "RowID", "left")
    zero_unknown = [c for c in ("bdrms", "baths", "totrms", "llota") if c in df.columns]
    df = df.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in zero_unknown})
    if "loba" in df.columns:
        df = df.withColumn("loba", F.when(F.col("loba") < 20_000, F.col("loba")))
    df = df.withColumns(
        {f"{d}Deed": F.when(F.col("deed_type") == d, 1).otherwise(0) for d in ("warranty", "foreclosure", "other")}
    )
    built = F.col("YearBuilt") >= codes.FIRST_YEAR
    sold_late = built & (F.col("DocumentDate") >= SALES_FROM_DAY)
    used = sold_late & (F.col("DataClassStndCode") == "H")
    means = stacked_means(
        df,
        columns,
        [("hoa", "hoa", None), ("hoa_neigh", "hoa_neigh", None), ("hoa, used", "hoa", used), ("hoa_neigh, used", "hoa_neigh", used)],
    )
    stages = {"built_1960": built, "sold_since": sold_late, "with_mortgage": used}
    left = None
    for status in ("hoa", "hoa_neigh"):
        counts = df.groupBy(F.col(status).cast("string").alias("value")).agg(
            F.count("*").alias("all_rows"), *[F.count_if(t).alias(n) for n, t in stages.items()]
        )
        counts = counts.withColumn("status", F.lit(status))
        left = counts if left is None else left.unionByName(counts)
    return means, left


def qualify_metros(transactions: DataFrame, columns: Sequence[str], min_n: int = 1000, min_rate: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Sales of metros with enough classified sales and flagged share, and their usable columns."""
    sales = transactions.filter(F.col("DataClassStndCode") == "H")
    classified = sales.filter(F.col("hoa_neigh").isin(0, 1))
    metros = qualified_groups(classified, ["cbsacode"], min_n, rate="hoa_neigh", min_rate=min_rate)
    sizes = sales.groupBy("cbsacode").agg(F.count("*").alias("_all")).join(metros.select("cbsacode"), "cbsacode")
    rows = attach_groups(sales, sizes, ["cbsacode"], "_all", "inner")
    rows = rows.fillna({"baths": 0, "topography": "other", "hoa_neigh": 10})
    return rows, usable_columns(rows, "cbsacode", columns, F.col("hoa_neigh").isin(0, 1))
