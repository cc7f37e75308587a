"""Association fees of listings by area."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plotmark.functions.scalars import clean_zip, gisjoin_county, gisjoin_state, zero_pad
from plotmark.operators.records import first_per_key
from plotmark.operators.spatial import points_in_polygons
from plotmark.operators.summaries import group_median, share_within
from plotmark.sources.contracts import lookup
from plotmark.sources.layout import valid_points


def listing_fee_by_area(listings: DataFrame, zip_county: DataFrame, divisions: DataFrame, min_n: int = 10, zip: str = "ZIP", fee: str = "HOA/MONTH") -> tuple[DataFrame, DataFrame]:
    """Median positive fee by county (with enough listings) and by division.

    A division median includes the listings of small counties, but a division is
    shown only when it has a county that is large enough. A code in several counties
    counts for the one with the least identifier.
    """
    county = first_per_key(
        zip_county.select(zero_pad("ZCTA5", 5).alias("zip5"), zero_pad("GEOID", 5).alias("county")), "zip5", ["county"]
    )
    fees = listings.select(clean_zip(F.col(f"`{zip}`")).alias("zip5"), F.col(f"`{fee}`").alias("fee")).filter("fee > 0")
    placed = lookup(fees, county, "zip5", "inner").withColumn("state_code", gisjoin_state("county"))
    placed = lookup(placed, divisions.select("state_code", "division_code"), "state_code", "inner")
    by_county = group_median(placed, ["county"], "fee", "co_median").filter(F.col("n") >= min_n)
    large = placed.select("county", "division_code").distinct().join(by_county.select("county"), "county", "left_semi")
    by_division = group_median(placed, ["division_code"], "fee", "division_median").join(
        large.select("division_code"), "division_code", "left_semi"
    )
    return (
        by_county.select(gisjoin_county("county").alias("GISJOIN"), "co_median", "n"),
        by_division.select("division_code", "division_median"),
    )


def listing_fee_by_polygon(listings: DataFrame, polygons: DataFrame, lon: str, lat: str, fee: str, poly_id: str = "GISJOIN") -> DataFrame:
    """Per polygon: listings, those with a fee, their share and mean fee (C11)."""
    placed = points_in_polygons(valid_points(listings, lon, lat), polygons, "inner", lon, lat, poly_id)
    fees = F.col(f"`{fee}`")
    density = share_within(placed, poly_id, fees.isNotNull())
    means = placed.groupBy(poly_id).agg(F.avg(fees).alias("fee_mean"))
    return density.join(means, poly_id)
