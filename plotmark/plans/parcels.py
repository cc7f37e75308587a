"""Parcel status, parcel features and clean transactions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from plotmark.functions.scalars import (
    QUALITY_RANK,
    age_at,
    category,
    day_number,
    flag,
    log_plus_one,
    map_values,
    not_in,
    present,
    ratio_in_range,
    top_code,
)
from plotmark.operators.areas import coverage_filter
from plotmark.operators.records import assemble, child_flag, ever_flag, first_per_key, first_values, flag_counts, largest_per_key
from plotmark.plans import codes
from plotmark.sources.contracts import lookup

# The column that numbers the records of a parcel in every assessment table.
SEQUENCE = "SequenceNumber"
# Rider columns of the transaction table.
RIDERS = {"pud": "PlannedUnitDevelopmentRiderFlag", "condo": "CondominiumRiderFlag"}


def linked_transactions(tx_main: DataFrame, property_info: DataFrame) -> DataFrame:
    """Transactions with the parcel they belong to; those without one are dropped."""
    return tx_main.join(property_info.select("TransId", "ImportParcelID").dropna(subset=["ImportParcelID"]), "TransId")


def parcel_status(
    main: DataFrame,
    building: DataFrame,
    tx_main: DataFrame,
    property_info: DataFrame,
    min_county: int = 5000,
    sequence: str = SEQUENCE,
) -> DataFrame:
    """One row per single-family parcel with its ever-flagged status.

    States without any flagged parcel, and large counties without one, do not record
    the flag and are left out.
    """
    houses = building.filter(F.col("PropertyLandUseStndCode") == codes.SINGLE_FAMILY)
    parcels = first_per_key(main.join(houses, "RowID"), "RowID", [sequence]).drop(sequence)
    status = ever_flag(
        linked_transactions(tx_main, property_info),
        "ImportParcelID",
        {name: F.col(c).isNotNull() for name, c in RIDERS.items()},
        F.col("DataClassStndCode").isin(*codes.MORTGAGE_CLASSES),
        status="hoa",
        observed_count="mortgage",
    ).drop(*RIDERS)
    area = F.col("PropertyAddressCensusTractAndBlock")
    placed = (
        parcels.join(status, "ImportParcelID")
        .drop("ImportParcelID")
        .withColumns({"county": F.substring(area, 1, 5), "state": F.substring(area, 1, 2)})
    )
    return coverage_filter(placed, "hoa", "county", "state", min_county)


def parcel_features(tables: Mapping[str, DataFrame], tx_main: DataFrame, property_info: DataFrame, metros: DataFrame, mode: str = "any", sequence: str = SEQUENCE) -> DataFrame:
    """Wide table of transacted single-family parcels built since 1960.

    ``tables`` holds the assessment tables by name. Every child table is reduced to
    one row per parcel before it is joined: the first one by the number in ``sequence``
    where a single record counts. Flags that no record of a parcel sets are filled in after the join.
    """
    key = "RowID"
    c = F.col
    building = first_per_key(tables["Building"], key, [sequence]).select(
        key,
        "NoOfUnits",
        "YearBuilt",
        "PropertyLandUseStndCode",
        "HeatingTypeorSystemStndCode",
        "AirConditioningTypeorSystemStndCode",
        present("OccupancyStatusStndCode").alias("ownerocc"),
        map_values("BuildingQualityStndCode", QUALITY_RANK).alias("buildquality"),
        c("TotalRooms").alias("totrms"),
        c("TotalBedrooms").alias("bdrms"),
        c("TotalCalculatedBathCount").alias("baths"),
        flag(c("FireplaceFlag").isNotNull() | c("FireplaceNumber").isNotNull()).alias("fireplace"),
        flag(c("RoofCoverStndCode") == codes.TILE_ROOF).alias("tile_rf"),
    )
    building = building.filter(
        (c("YearBuilt") >= codes.FIRST_YEAR)
        & (c("PropertyLandUseStndCode") == codes.SINGLE_FAMILY)
        & c("bdrms").isNotNull()
    )
    riders = {name: c(col).isNotNull() for name, col in RIDERS.items()}
    riders["mortgage"] = c("DataClassStndCode").isin(*codes.MORTGAGE_CLASSES)
    seen = flag_counts(linked_transactions(tx_main, property_info), "ImportParcelID", riders)
    parent = tables["Main"].join(seen, "ImportParcelID").join(building, key)

    appeal, floor = tables["LotSiteAppeal"], tables["InteriorFlooring"]
    areas, garage, extra = tables["BuildingAreas"], tables["Garage"], tables["ExtraFeature"]
    children = [
        first_per_key(tables["Value"].select(key, sequence, "TotalAssessedValue"), key, [sequence]).drop(sequence),
        child_flag(appeal, key, {
            "waterfrnt": c("LotSiteAppealStndCode").isin(*codes.WATERFRONT),
            "golf": c("LotSiteAppealStndCode").isin(*codes.GOLF),
        }, mode, [sequence], unset=False),
        largest_per_key(areas, key, "BuildingAreaSqFt",
                        (c("BuildingAreaSequenceNumber") == 1) & c("BuildingAreaStndCode").isin(*codes.LIVING_AREAS)),
        child_flag(floor, key, {
            "carpet_fl": c("InteriorFlooringTypeStndCode").isin(*codes.CARPET),
            "wood_fl": c("InteriorFlooringTypeStndCode").isin(*codes.WOOD_FLOOR),
        }, mode, [sequence], unset=False),
        first_per_key(tables["ExteriorWall"].select(key, sequence, "ExteriorWallStndCode"), key, [sequence]).select(
            key, category("ExteriorWallStndCode", codes.WALL_GROUPS).alias("extwall")),
        first_values(garage, key, ["GarageAreaSqFt", "GarageNoOfCars"], sequence),
        child_flag(extra, key, {
            "deck": c("ExtraFeaturesStndCode").isin(*codes.DECK),
            "fence": c("ExtraFeaturesStndCode").startswith(codes.FENCE_PREFIX),
        }, mode, [sequence], unset=False),
        child_flag(tables["Pool"], key, {"pool": c("PoolStndCode").isin(*codes.POOL)}, mode, [sequence], unset=False),
        tables["Oby"].groupBy(key).agg(F.coalesce(F.sum("OBYAreaSqFt"), F.lit(0.0)).alias("oby_sqft")),
    ]
    absent = ["GarageAreaSqFt", "GarageNoOfCars", "pool", "deck", "golf", "waterfrnt", "carpet_fl", "wood_fl", "fence"]
    defaults = {**{name: 0 for name in absent}, "oby_sqft": 0.0, "extwall": "none"}
    wide = assemble(parent, children, key, defaults)
    wide = wide.withColumns(
        {
            "tax_rate": ratio_in_range("TaxAmount", "TotalAssessedValue", 0, 0.1),
            "tract": F.substring("PropertyAddressCensusTractAndBlock", 1, 9),
        }
    ).filter(c("tract").isNotNull())
    county = metros.select(
        F.concat("fipsstatecode", "fipscountycode").alias("FIPS"), "cbsacode", "cbsatitle"
    )
    return lookup(wide, county, "FIPS").drop(
        "TaxAmount", "TotalAssessedValue", "PropertyAddressCensusTractAndBlock"
    )


def clean_transactions(parcels: DataFrame, tx_main: DataFrame, property_info: DataFrame) -> DataFrame:
    """Arm's-length sales of known parcels, with logged sizes and fewer categories."""
    c = F.col
    sales = tx_main.filter(
        c("SalesPriceAmount").between(*codes.PRICE_RANGE)
        & not_in("SalesPriceAmountStndCode", codes.BAD_PRICE_CODES)
        & c("IntraFamilyTransferFlag").isNull()
        & c("DataClassStndCode").isin(*codes.SALE_CLASSES)
    ).select(
        "TransId", "DataClassStndCode", "RecordingDate", "DocumentTypeStndCode", "DocumentDate", "SalesPriceAmount"
    )
    homes = parcels.filter(
        (c("LotSizeSquareFeet") <= codes.MAX_LOT_SQFT) & c("BuildingAreaSqFt").between(*codes.BUILDING_SQFT_RANGE)
    )
    trans = linked_transactions(sales, property_info).join(homes, "ImportParcelID")
    year = F.substring("RecordingDate", 1, 4).try_cast("double")
    trans = trans.withColumns(
        {
            "hoa": flag(c("pud") + c("condo") > 0),
            "ageAtSale": age_at(year, c("YearBuilt")),
            "DocumentDate": day_number(F.coalesce("DocumentDate", "RecordingDate")).cast("double"),
            "lprice": F.log("SalesPriceAmount"),
            "lba": log_plus_one("BuildingAreaSqFt"),
            "llota": log_plus_one("LotSizeSquareFeet"),
            "lgara": log_plus_one("GarageAreaSqFt"),
            "loba": log_plus_one("oby_sqft"),
            "deed_type": category("DocumentTypeStndCode", codes.DEED_GROUPS),
            "topography": F.when(c("LotSiteTopographyStndCode").isin(*codes.OTHER_TOPOGRAPHY), "other").otherwise(
                c("LotSiteTopographyStndCode")
            ),
            **{name: top_code(name, cap) for name, cap in codes.ROOM_CAPS.items()},
        }
    )
    required = ["FIPS", "lprice", "DocumentDate", "tract", "PropertyAddressLongitude", "PropertyAddressLatitude"]
    return trans.dropna(subset=required).drop(
        "ImportParcelID", "YearBuilt", "RecordingDate", "SalesPriceAmount", "DocumentTypeStndCode",
        "LotSizeSquareFeet", "BuildingAreaSqFt", "GarageAreaSqFt", "oby_sqft", "pud", "condo",
        "LotSiteTopographyStndCode",
    )
