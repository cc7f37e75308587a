"""Whole analyses on stand-ins of the assessment and transaction families."""

from pyspark.sql import functions as F

from checks.roles import SQL_STATUS, parcels, query, r6, table
from plotmark.functions.status import cutoff_status
from plotmark.operators.areas import group_share, with_mode
from plotmark.plans import effects, listings, parcels as parcel_plans, profiles
from plotmark.session import materialize


def select_sql(spark, sf, name: str, sql: str):
    """A stand-in table from one of the supplied tables, by SELECT expressions."""
    return table(spark, sf, name).selectExpr(*[e.strip() for e in sql.strip().split(";")])


# Each entry is valid in both SQL dialects; ``;`` separates the columns.
MAIN = """p_partkey AS RowID; concat('P', CAST(p_partkey AS STRING)) AS ImportParcelID; concat('0', CAST(1001 + p_size % 25 AS STRING)) AS FIPS;
 p_name AS PropertyFullStreetAddress; p_brand AS LegalSubdivisionName; p_retailprice / 50 AS TaxAmount; p_retailprice * 40 AS LotSizeSquareFeet;
 CASE WHEN p_size % 4 = 0 THEN 'MT' WHEN p_size % 4 = 1 THEN 'LV' END AS LotSiteTopographyStndCode;
 30 + (p_partkey % 101) / 100.0 AS PropertyAddressLatitude; -90 - (p_partkey % 103) / 100.0 AS PropertyAddressLongitude;
 CASE WHEN p_partkey % 19 > 0 THEN concat('0', CAST(1001 + p_size % 25 AS STRING), CAST(100000 + p_partkey % 7 AS STRING), CAST(1001 + p_partkey % 3 AS STRING)) END AS PropertyAddressCensusTractAndBlock"""
BUILDING = """p_partkey AS RowID; 1 AS SequenceNumber; 1 AS NoOfUnits; CASE WHEN p_type = 'PROMO' THEN 'RR102' ELSE 'RR101' END AS PropertyLandUseStndCode; 1950.0 + p_size AS YearBuilt;
 CASE WHEN p_size % 2 = 0 THEN 'O' END AS OccupancyStatusStndCode; CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C-' END AS BuildingQualityStndCode;
 p_size % 14 AS TotalRooms; CASE WHEN p_partkey % 23 > 0 THEN p_size % 8 END AS TotalBedrooms; p_size % 7 AS TotalCalculatedBathCount;
 CASE WHEN p_size % 5 = 0 THEN 'TL' END AS RoofCoverStndCode; 'FA' AS HeatingTypeorSystemStndCode; 'CE' AS AirConditioningTypeorSystemStndCode;
 CASE WHEN p_size % 6 = 0 THEN 'Y' END AS FireplaceFlag; CASE WHEN p_size % 10 = 1 THEN 2 END AS FireplaceNumber"""
CHILD = """l_partkey AS RowID; l_orderkey * 10 + l_linenumber AS SequenceNumber; l_linenumber AS BuildingAreaSequenceNumber; CASE l_returnflag WHEN 'A' THEN 'BAB' WHEN 'R' THEN 'BAL' ELSE 'ZZ' END AS BuildingAreaStndCode;
 l_extendedprice / 20 AS BuildingAreaSqFt; CASE WHEN l_discount > 0.09 THEN 'VWL' WHEN l_discount > 0.08 THEN 'GLF' ELSE 'XX' END AS LotSiteAppealStndCode;
 CASE WHEN l_tax > 0.07 THEN 'CP' WHEN l_tax > 0.06 THEN 'WD' ELSE 'XX' END AS InteriorFlooringTypeStndCode;
 CASE l_returnflag WHEN 'A' THEN 'BR' WHEN 'R' THEN 'WD' ELSE 'QQ' END AS ExteriorWallStndCode; CASE WHEN l_quantity > 20 THEN l_quantity * 10 END AS GarageAreaSqFt;
 CASE WHEN l_quantity < 25 THEN l_linenumber END AS GarageNoOfCars; CASE WHEN l_quantity > 49 THEN 'DCK' WHEN l_quantity < 2 THEN 'FN1' ELSE 'XX' END AS ExtraFeaturesStndCode;
 CASE WHEN l_extendedprice > 95000 THEN 'POL' ELSE 'XX' END AS PoolStndCode; l_quantity * 2 AS OBYAreaSqFt"""
TX = """o_orderkey AS TransId; concat('P', CAST(o_custkey AS STRING)) AS ImportParcelID; CASE o_orderstatus WHEN 'F' THEN 'H' WHEN 'O' THEN 'D' ELSE 'M' END AS DataClassStndCode;
 CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0 THEN 'X' END AS PlannedUnitDevelopmentRiderFlag; CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 11 = 0 THEN 'X' END AS CondominiumRiderFlag;
 CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 YEAR AS DATE) AS STRING) AS RecordingDate; CASE WHEN o_orderkey % 5 > 0 THEN CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 YEAR AS DATE) AS STRING) END AS DocumentDate; o_totalprice AS SalesPriceAmount;
 CASE WHEN o_orderpriority = '5-LOW' THEN 'CU' WHEN o_orderpriority = '3-MEDIUM' THEN 'RD' END AS SalesPriceAmountStndCode; CASE WHEN o_orderkey % 13 = 0 THEN 'Y' END AS IntraFamilyTransferFlag;
 CASE o_orderkey % 3 WHEN 0 THEN 'WRDE' WHEN 1 THEN 'TXDE' END AS DocumentTypeStndCode"""


def as_sql(name: str, source: str, columns: str) -> str:
    return f"{name} AS (SELECT {', '.join(e.strip() for e in columns.strip().split(';'))} FROM {source})".replace("AS STRING", "AS VARCHAR")


FAMILY = ", ".join([as_sql("main", "part", MAIN), as_sql("building", "part", BUILDING), as_sql("child", "lineitem", CHILD), as_sql("tx", "orders", TX)])


def family(spark, sf):
    child = select_sql(spark, sf, "lineitem", CHILD)
    columns = {
        "LotSiteAppeal": ["LotSiteAppealStndCode"],
        "BuildingAreas": ["BuildingAreaSequenceNumber", "BuildingAreaStndCode", "BuildingAreaSqFt"],
        "InteriorFlooring": ["InteriorFlooringTypeStndCode"],
        "ExteriorWall": ["ExteriorWallStndCode"],
        "Garage": ["GarageAreaSqFt", "GarageNoOfCars"],
        "ExtraFeature": ["ExtraFeaturesStndCode"],
        "Pool": ["PoolStndCode"],
        "Oby": ["OBYAreaSqFt"],
    }
    tables = {name: child.select("RowID", "SequenceNumber", *cs) for name, cs in columns.items()}
    tables["Main"], tables["Building"] = select_sql(spark, sf, "part", MAIN), select_sql(spark, sf, "part", BUILDING)
    tables["Value"] = table(spark, sf, "part").selectExpr(
        "p_partkey AS RowID", "1 AS SequenceNumber", "p_retailprice * (p_partkey % 5) AS TotalAssessedValue"
    )
    tx = select_sql(spark, sf, "orders", TX)
    return tables, tx.drop("ImportParcelID"), tx.select("TransId", "ImportParcelID")


def metros(spark, sf):
    return table(spark, sf, "nation").selectExpr(
        "'01' AS fipsstatecode", "substring(CAST(1001 + n_nationkey AS STRING), 2, 3) AS fipscountycode",
        "CAST(10000 + n_nationkey AS STRING) AS cbsacode", "n_name AS cbsatitle",
    ).filter("cbsacode <> '10003'")


STATUS = f"""{FAMILY}, st AS (SELECT ImportParcelID, count(PlannedUnitDevelopmentRiderFlag) AS pud, count(CondominiumRiderFlag) AS condo,
  count(*) FILTER (DataClassStndCode IN ('H', 'M')) AS mortgage FROM tx GROUP BY 1)"""


@query(f"""WITH {STATUS}, h AS (SELECT RowID, LegalSubdivisionName, YearBuilt, substring(PropertyAddressCensusTractAndBlock, 1, 5) AS county, mortgage,
   CASE WHEN mortgage > 0 THEN CASE WHEN pud + condo > 0 THEN 1 ELSE 0 END END AS hoa
   FROM main JOIN building USING (RowID) JOIN st USING (ImportParcelID) WHERE PropertyLandUseStndCode = 'RR101' AND PropertyAddressCensusTractAndBlock IS NOT NULL),
 c AS (SELECT county, avg(hoa) AS rate, count(hoa) AS n FROM h GROUP BY 1)
 SELECT RowID, county, '01' AS state, YearBuilt::DOUBLE AS YearBuilt, mortgage::BIGINT AS mortgage, hoa FROM h JOIN c USING (county) WHERE NOT coalesce(rate = 0 AND n >= 20, false)""")
def parcels_with_status(spark, sf):
    """Single-family parcels with ever-flagged status, less areas without coverage."""
    tables, tx, info = family(spark, sf)
    found = parcel_plans.parcel_status(tables["Main"], tables["Building"], tx, info, 20)
    return found.select("RowID", "county", "state", F.col("YearBuilt").cast("double"), "mortgage", "hoa")


FIRST_CHILD = """first AS (SELECT RowID, arg_min(coalesce(ExteriorWallStndCode, ''), SequenceNumber) AS wall, max(CASE WHEN LotSiteAppealStndCode = 'VWL' THEN 1 ELSE 0 END) AS waterfrnt,
   max(CASE WHEN LotSiteAppealStndCode = 'GLF' THEN 1 ELSE 0 END) AS golf, max(CASE WHEN InteriorFlooringTypeStndCode = 'CP' THEN 1 ELSE 0 END) AS carpet_fl,
   max(CASE WHEN InteriorFlooringTypeStndCode = 'WD' THEN 1 ELSE 0 END) AS wood_fl, max(CASE WHEN ExtraFeaturesStndCode = 'DCK' THEN 1 ELSE 0 END) AS deck,
   max(CASE WHEN ExtraFeaturesStndCode LIKE 'FN%' THEN 1 ELSE 0 END) AS fence, max(CASE WHEN PoolStndCode = 'POL' THEN 1 ELSE 0 END) AS pool, sum(OBYAreaSqFt) AS oby_sqft,
   arg_min(GarageAreaSqFt, SequenceNumber) FILTER (GarageAreaSqFt IS NOT NULL) AS gsqft, arg_min(GarageNoOfCars, SequenceNumber) FILTER (GarageNoOfCars IS NOT NULL) AS cars,
   max(BuildingAreaSqFt) FILTER (BuildingAreaSequenceNumber = 1 AND BuildingAreaStndCode IN ('BAB', 'BAL')) AS area FROM child GROUP BY 1)"""


@query(f"""WITH {STATUS}, {FIRST_CHILD}
 SELECT m.RowID, m.FIPS, pud, condo, st.mortgage::BIGINT AS mortgage, b.YearBuilt::DOUBLE AS YearBuilt, CASE WHEN OccupancyStatusStndCode IS NULL THEN 0 ELSE 1 END AS ownerocc,
  CASE BuildingQualityStndCode WHEN 'A' THEN 2 WHEN 'C-' THEN 9 END AS buildquality, TotalBedrooms AS bdrms,
  CASE WHEN FireplaceFlag IS NOT NULL OR FireplaceNumber IS NOT NULL THEN 1 ELSE 0 END AS fireplace, CASE WHEN RoofCoverStndCode = 'TL' THEN 1 ELSE 0 END AS tile_rf,
  CASE WHEN m.RowID % 5 > 0 AND TaxAmount / (50.0 * TaxAmount * (m.RowID % 5)) BETWEEN 0 AND 0.1 THEN round(1 / (50.0 * (m.RowID % 5)), 6) END AS tax_rate,
  coalesce(waterfrnt, 0) AS waterfrnt, coalesce(golf, 0) AS golf, coalesce(carpet_fl, 0) AS carpet_fl, coalesce(wood_fl, 0) AS wood_fl, coalesce(deck, 0) AS deck,
  coalesce(fence, 0) AS fence, coalesce(pool, 0) AS pool, coalesce(oby_sqft, 0) AS oby_sqft, coalesce(gsqft, 0) AS "GarageAreaSqFt", coalesce(cars, 0) AS "GarageNoOfCars",
  round(area, 4) AS "BuildingAreaSqFt", CASE wall WHEN 'BR' THEN 'brick' WHEN 'WD' THEN 'wood' WHEN 'QQ' THEN 'other' ELSE 'none' END AS extwall,
  substring(PropertyAddressCensusTractAndBlock, 1, 9) AS tract, CASE WHEN p_size % 25 <> 3 THEN CAST(10000 + p_size % 25 AS VARCHAR) END AS cbsacode
 FROM main m JOIN building b ON b.RowID = m.RowID JOIN st USING (ImportParcelID) JOIN part ON p_partkey = m.RowID LEFT JOIN first f ON f.RowID = m.RowID
 WHERE YearBuilt >= 1960 AND PropertyLandUseStndCode = 'RR101' AND TotalBedrooms IS NOT NULL AND PropertyAddressCensusTractAndBlock IS NOT NULL""")
def wide_parcels(spark, sf):
    tables, tx, info = family(spark, sf)
    found = parcel_plans.parcel_features(tables, tx, info, metros(spark, sf))
    return found.select(
        "RowID", "FIPS", "pud", "condo", "mortgage", F.col("YearBuilt").cast("double"), "ownerocc", "buildquality", "bdrms", "fireplace", "tile_rf",
        r6("tax_rate").alias("tax_rate"), "waterfrnt", "golf", "carpet_fl", "wood_fl", "deck", "fence", "pool", "oby_sqft", "GarageAreaSqFt",
        "GarageNoOfCars", r6("BuildingAreaSqFt", 4).alias("BuildingAreaSqFt"), "extwall", "tract", "cbsacode",
    )


SALES = f"""{STATUS}, {FIRST_CHILD}, home AS (SELECT RowID, ImportParcelID, FIPS, pud, condo, YearBuilt, LotSizeSquareFeet, area, coalesce(gsqft, 0) AS gsqft, coalesce(oby_sqft, 0) AS oby,
   TotalRooms, TotalBedrooms, TotalCalculatedBathCount, CASE wall WHEN 'BR' THEN 'brick' WHEN 'WD' THEN 'wood' WHEN 'QQ' THEN 'other' ELSE 'none' END AS extwall,
   coalesce(pool, 0) AS pool, LotSiteTopographyStndCode AS topo, substring(PropertyAddressCensusTractAndBlock, 1, 9) AS tract
   FROM main JOIN building USING (RowID) JOIN st USING (ImportParcelID) LEFT JOIN first USING (RowID)
   WHERE YearBuilt >= 1960 AND PropertyLandUseStndCode = 'RR101' AND TotalBedrooms IS NOT NULL)"""


def sales(spark, sf):
    """C3 on the result of C2."""
    tables, tx, info = family(spark, sf)
    homes = materialize(parcel_plans.parcel_features(tables, tx, info, metros(spark, sf)), "homes")
    return parcel_plans.clean_transactions(homes, tx, info)


CLEAN = """clean AS (SELECT TransId, RowID, FIPS, DataClassStndCode, CASE WHEN pud + condo > 0 THEN 1 ELSE 0 END AS hoa, tract, YearBuilt, area, LotSizeSquareFeet,
  CASE WHEN CAST(substring(RecordingDate, 1, 4) AS DOUBLE) >= YearBuilt THEN CAST(substring(RecordingDate, 1, 4) AS DOUBLE) - YearBuilt END AS ageAtSale,
  date_diff('day', DATE '1960-01-01', CAST(coalesce(DocumentDate, RecordingDate) AS DATE)) AS day, ln(SalesPriceAmount) AS lprice, ln(area + 1) AS lba, ln(LotSizeSquareFeet + 1) AS llota, ln(gsqft + 1) AS lgara, ln(oby + 1) AS loba, extwall, pool,
  CASE DocumentTypeStndCode WHEN 'WRDE' THEN 'warranty' WHEN 'TXDE' THEN 'foreclosure' ELSE 'other' END AS deed_type, CASE topo WHEN 'MT' THEN 'other' ELSE topo END AS topography,
  least(TotalRooms, 10) AS totrms, CASE WHEN TotalBedrooms >= 6 THEN 6 ELSE TotalBedrooms END AS bdrms, least(TotalCalculatedBathCount, 5) AS baths
  FROM tx JOIN home USING (ImportParcelID) WHERE SalesPriceAmount BETWEEN 1000 AND 5000000 AND coalesce(SalesPriceAmountStndCode <> 'CU', true) AND IntraFamilyTransferFlag IS NULL
  AND DataClassStndCode IN ('D', 'H') AND LotSizeSquareFeet <= 87120 AND area BETWEEN 1 AND 15000 AND tract IS NOT NULL)"""


@query(f"""WITH {SALES}, {CLEAN} SELECT TransId, RowID, hoa, round(ageAtSale, 2) AS ageAtSale, day::DOUBLE AS "DocumentDate", round(lprice, 6) AS lprice, round(lba, 6) AS lba,
 round(llota, 6) AS llota, round(lgara, 6) AS lgara, round(loba, 6) AS loba, extwall, pool, deed_type, topography, totrms, bdrms, baths, tract FROM clean""")
def clean_transactions(spark, sf):
    found = sales(spark, sf)
    return found.select(
        "TransId", "RowID", "hoa", r6(F.col("ageAtSale").cast("double"), 2).alias("ageAtSale"), "DocumentDate",
        *[r6(c).alias(c) for c in ("lprice", "lba", "llota", "lgara", "loba")], "extwall", "pool", "deed_type", "topography", "totrms", "bdrms", "baths", "tract",
    )


BUILT = f"""{SQL_STATUS}, k AS (SELECT RowID, county, 'Z' || (RowID % 30) AS zone, YearBuilt, hoa, value FROM parcels),
 nz AS (SELECT zone, avg(hoa) AS s FROM k GROUP BY 1), yc AS (SELECT zone, YearBuilt AS mode, row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, YearBuilt) AS i FROM k GROUP BY 1, 2),
 p AS (SELECT k.*, CASE WHEN s >= 0.55 THEN 1 WHEN s >= 0.5 THEN 9 ELSE 0 END AS neigh, mode FROM k JOIN nz USING (zone) JOIN yc ON yc.zone = k.zone AND i = 1),
 q AS (SELECT *, CASE WHEN neigh IN (0, 1) AND abs(YearBuilt - mode) <= 5 THEN neigh END AS fresh FROM p)"""


def built(spark, sf):
    """Parcels with an inferred status and modal year from thirty zones."""
    df = parcels(spark, sf).withColumn("zone", F.concat(F.lit("Z"), (F.col("RowID") % 30).cast("string")))
    df = group_share(df, ["zone"], "hoa", "s", 1)
    df = with_mode(df, ["zone"], "YearBuilt", "YearBuilt_mode")
    return df.withColumn("hoa_neigh", cutoff_status("s", 0.5, 0.55))


@query(f"""WITH {BUILT} SELECT YearBuilt, round(avg(hoa), 6) AS all_houses, round(avg(fresh), 6) AS new_subdivisions FROM q WHERE YearBuilt BETWEEN 1940 AND 2015
 GROUP BY 1 HAVING avg(hoa) IS NOT NULL AND avg(fresh) IS NOT NULL""")
def status_trend(spark, sf):
    found = profiles.status_trend(built(spark, sf))
    return found.select("YearBuilt", r6("all_houses").alias("all_houses"), r6("new_subdivisions").alias("new_subdivisions"))


@query(f"""WITH {BUILT}, x AS (SELECT *, CASE WHEN county % 4 > 0 THEN 'M' || (county % 4) END AS cbsacode, lpad(CAST(county AS VARCHAR), 5, '0') AS co, 'G' || (county % 3) AS division_code FROM q)
 SELECT 'cbsacode' AS level, cbsacode AS area, NULL AS gisjoin, round(avg(hoa), 6) AS hoa_pct, round(avg(CASE WHEN YearBuilt BETWEEN 2000 AND 2015 THEN hoa END), 6) AS hoa_pct_new FROM x WHERE cbsacode IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'county', co, 'G' || co[1:2] || '0' || co[3:] || '0', round(avg(hoa), 6), round(avg(CASE WHEN YearBuilt BETWEEN 2000 AND 2015 THEN fresh END), 6) FROM x GROUP BY co
 UNION ALL SELECT 'division_code', division_code, NULL, round(round_even(avg(hoa), 2) * 100, 6), round(round_even(avg(CASE WHEN YearBuilt BETWEEN 2000 AND 2015 THEN fresh END), 2) * 100, 6) FROM x GROUP BY 2""")
def rates_by_area(spark, sf):
    k = F.col("county")
    df = built(spark, sf).withColumns(
        {"cbsacode": F.when(k % 4 > 0, F.concat(F.lit("M"), (k % 4).cast("string"))), "division_code": F.concat(F.lit("G"), (k % 3).cast("string"))}
    )
    df = df.withColumn("county", F.lpad(k.cast("string"), 5, "0"))
    found = profiles.rates_by_area(df)
    return found.select("level", "area", "gisjoin", r6("hoa_pct").alias("hoa_pct"), r6("hoa_pct_new").alias("hoa_pct_new"))


CENSUS = """cen AS (SELECT n_nationkey, 1000 + n_nationkey * 10 AS total_pop, 400 + n_nationkey AS white, 600 + n_nationkey * 9 AS black,
  CASE WHEN n_nationkey % 5 > 0 THEN 50000.0 + n_nationkey END AS med_hs_income FROM nation)"""


@query(f"""WITH {SQL_STATUS}, {CENSUS}, a AS (SELECT county, avg(hoa) AS f FROM parcels GROUP BY 1 HAVING count(*) >= 3),
 j AS (SELECT *, white * 1.0 / total_pop AS ws, black * 1.0 / total_pop AS bs FROM a JOIN cen ON n_nationkey = county),
 w AS (SELECT 'hoa' AS weight, total_pop * f AS wt, ws, bs, med_hs_income AS inc FROM j UNION ALL SELECT 'nonhoa', total_pop * (1 - f), ws, bs, med_hs_income FROM j)
 SELECT weight, round(sum(wt * ws) / sum(wt), 6) AS white_geoid, round(sum(wt * bs) / sum(wt), 6) AS black_geoid, round(sum(wt * inc) / sum(wt) FILTER (inc IS NOT NULL), 4) AS med_hs_income FROM w GROUP BY 1""")
def census_profile(spark, sf):
    n = F.lpad(F.col("county").cast("string"), 3, "0")
    homes_ = parcels(spark, sf).withColumn("PropertyAddressCensusTractAndBlock", F.concat(F.lit("01"), n, F.lit("00109001")))
    n = F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    census = table(spark, sf, "nation").select(
        F.concat(F.lit("G010"), n, F.lit("00010001")).alias("GISJOIN"), (1000 + F.col("n_nationkey") * 10).alias("total_pop"),
        (400 + F.col("n_nationkey")).alias("white"), (600 + F.col("n_nationkey") * 9).alias("black"),
        F.when(F.col("n_nationkey") % 5 > 0, 50000.0 + F.col("n_nationkey")).alias("med_hs_income"),
    )
    census = census.withColumn("GISJOIN", F.concat(F.substring("GISJOIN", 1, 8), F.lit("0010001")))
    profile, _ = profiles.census_weighted_profile(homes_, census, ["white", "black"], min_n=3)
    return profile.select("weight", *[r6(c).alias(c) for c in ("white_geoid", "black_geoid")], r6("med_hs_income", 4).alias("med_hs_income"))


@query(f"""WITH {BUILT}, t AS (SELECT o_custkey AS RowID, o_orderkey, ln(o_totalprice) AS lprice, o_orderkey % 4 AS bdrms,
   date_diff('day', DATE '1960-01-01', CAST(o_orderdate AS DATE))::DOUBLE + 3650 AS dd, CASE o_orderstatus WHEN 'F' THEN 'H' ELSE 'D' END AS cls FROM orders),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY RowID ORDER BY o_orderkey) AS i FROM t) WHERE i = 1),
 j AS (SELECT q.hoa, q.neigh, exp(lprice) AS price, nullif(bdrms, 0) AS bd, YearBuilt >= 1960 AND dd >= 16425 AND cls = 'H' AS used FROM q LEFT JOIN f USING (RowID))
 SELECT 'hoa' AS grouping, CAST(hoa AS VARCHAR) AS value, count(*) AS n, round(avg(price), 2) AS lprice, round(avg(bd), 6) AS bdrms FROM j WHERE hoa IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'hoa_neigh', CAST(neigh AS VARCHAR), count(*), round(avg(price), 2), round(avg(bd), 6) FROM j GROUP BY 2
 UNION ALL SELECT 'hoa, used', CAST(hoa AS VARCHAR), count(*), round(avg(price), 2), round(avg(bd), 6) FROM j WHERE used AND hoa IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'hoa_neigh, used', CAST(neigh AS VARCHAR), count(*), round(avg(price), 2), round(avg(bd), 6) FROM j WHERE used GROUP BY 2""")
def property_summary(spark, sf):
    means, _ = profiles.group_summary_table(built(spark, sf), sold_parcels(spark, sf), ["lprice", "bdrms"])
    return means.select("grouping", "value", "n", r6("lprice", 2).alias("lprice"), r6("bdrms").alias("bdrms"))


def sold_parcels(spark, sf):
    day = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1960-01-01"))).cast("double") + 3650
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("TransId"), F.col("o_custkey").alias("RowID"), F.log("o_totalprice").alias("lprice"), (F.col("o_orderkey") % 4).alias("bdrms"),
        day.alias("DocumentDate"), F.when(F.col("o_orderstatus") == "F", "H").otherwise("D").alias("DataClassStndCode"), F.lit("warranty").alias("deed_type"),
    )


@query(f"""WITH {BUILT}, f AS (SELECT * FROM (SELECT o_custkey AS RowID, date_diff('day', DATE '1960-01-01', CAST(o_orderdate AS DATE)) + 3650 AS dd, o_orderstatus = 'F' AS h,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i = 1), j AS (SELECT * FROM q LEFT JOIN f USING (RowID))
 SELECT 'hoa' AS status, CAST(hoa AS VARCHAR) AS value, count(*) AS all_rows, count(*) FILTER (YearBuilt >= 1960) AS built_1960, count(*) FILTER (YearBuilt >= 1960 AND dd >= 16425) AS sold_since,
  count(*) FILTER (YearBuilt >= 1960 AND dd >= 16425 AND h) AS with_mortgage FROM j GROUP BY 2
 UNION ALL SELECT 'hoa_neigh', CAST(neigh AS VARCHAR), count(*), count(*) FILTER (YearBuilt >= 1960), count(*) FILTER (YearBuilt >= 1960 AND dd >= 16425),
  count(*) FILTER (YearBuilt >= 1960 AND dd >= 16425 AND h) FROM j GROUP BY 2""")
def property_attrition(spark, sf):
    _, left = profiles.group_summary_table(built(spark, sf), sold_parcels(spark, sf), ["lprice"])
    return left.select("status", "value", "all_rows", "built_1960", "sold_since", "with_mortgage")


@query("""WITH t AS (SELECT l_suppkey % 10 AS m, l_orderkey, CASE WHEN l_linestatus = 'F' THEN 'H' ELSE 'D' END AS cls, CASE WHEN l_suppkey % 10 < 4 AND l_linenumber > 1 THEN 0 WHEN l_linenumber <= 2 THEN 1 WHEN l_linenumber < 6 THEN 0 ELSE 9 END AS ng FROM lineitem),
 s AS (SELECT 'M' || m AS cbsacode, ng FROM t WHERE cls = 'H'), g AS (SELECT cbsacode FROM s WHERE ng IN (0, 1) GROUP BY 1 HAVING count(*) >= 1000 AND avg(ng) >= 0.3)
 SELECT cbsacode, count(*) AS n, CAST(sum(ng) AS BIGINT) AS ng FROM s WHERE cbsacode IN (SELECT cbsacode FROM g) GROUP BY 1""")
def qualified_metros(spark, sf):
    m, line = F.col("l_suppkey") % 10, F.col("l_linenumber")
    status = F.when((m < 4) & (line > 1), 0).when(line <= 2, 1).when(line < 6, 0).otherwise(9)
    tx = table(spark, sf, "lineitem").select(
        F.concat(F.lit("M"), m.cast("string")).alias("cbsacode"), F.when(F.col("l_linestatus") == "F", "H").otherwise("D").alias("DataClassStndCode"),
        status.alias("hoa_neigh"), F.col("l_quantity").alias("baths"), F.col("l_returnflag").alias("topography"),
    )
    rows, _ = profiles.qualify_metros(tx, ["baths", "topography"], 1000, 0.3)
    return rows.groupBy("cbsacode").agg(F.count("*").alias("n"), F.sum("hoa_neigh").alias("ng"))


FEES = """f AS (SELECT format('{:05d}', o_custkey) AS zip, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 ELSE 0 END AS fee FROM orders),
 z AS (SELECT format('{:05d}', c_custkey) AS zip, format('{:05d}', c_nationkey * 1000 + c_custkey % 12) AS county FROM customer),
 j AS (SELECT county, 'G' || county[1:2] AS st, fee FROM f JOIN z USING (zip) WHERE fee > 0)"""


@query(f"WITH {FEES} SELECT 'G' || county[1:2] || '0' || county[3:] || '0' AS \"GISJOIN\", round(median(fee), 6) AS co_median, count(*) AS n FROM j GROUP BY county HAVING count(*) >= 45")
def fee_by_county(spark, sf):
    return _fees(spark, sf)[0].withColumn("co_median", r6("co_median"))


@query(f"""WITH {FEES}, d AS (SELECT j.*, 'D' || (CAST(county[1:2] AS BIGINT) % 4) AS division_code FROM j), ok AS (SELECT DISTINCT division_code FROM d GROUP BY county, division_code HAVING count(*) >= 45)
 SELECT division_code, round(median(fee), 6) AS division_median FROM d WHERE division_code IN (SELECT division_code FROM ok) GROUP BY 1""")
def fee_by_division(spark, sf):
    return _fees(spark, sf)[1].withColumn("division_median", r6("division_median"))


def _fees(spark, sf):
    customer = table(spark, sf, "customer")
    listed = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("ZIP"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000).otherwise(0.0).alias("HOA/MONTH"),
    )
    zips = customer.select(
        F.col("c_custkey").cast("string").alias("ZCTA5"), (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 12).cast("string").alias("GEOID")
    )
    divisions = table(spark, sf, "nation").select(
        F.concat(F.lit("G"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("state_code"),
        F.concat(F.lit("D"), (F.col("n_nationkey") % 4).cast("string")).alias("division_code"),
    )
    return listings.listing_fee_by_area(listed, zips, divisions, 45)


def analysis_rows(spark, sf):
    """Sales since the start day with dummies, month, block group and a nation covariate."""
    tables, _, _ = family(spark, sf)
    tx = sales(spark, sf).withColumn("hoa_neigh", F.col("RowID") % 3)
    region = table(spark, sf, "nation").select(F.concat(F.lit("0"), (1001 + F.col("n_nationkey")).cast("string")).alias("FIPS"), "n_regionkey")
    return effects.regression_base(tx.drop("LegalSubdivisionName"), tables["Main"], [(region, "FIPS")], ["bdrms", "topography"])


@query(f"""WITH {SALES}, {CLEAN}, r AS (SELECT c.*, substring(PropertyAddressCensusTractAndBlock, 1, 9) || substring(PropertyAddressCensusTractAndBlock, 11, 3) AS geoid, LegalSubdivisionName AS sub
   FROM clean c JOIN main m ON m.RowID = c.RowID WHERE day >= 16425 AND DataClassStndCode = 'H'), n AS (SELECT FIPS, sub, count(*) AS size FROM r GROUP BY 1, 2)
 SELECT TransId, geoid, CASE WHEN RowID % 3 < 2 THEN RowID % 3 END AS "HOA_NEIGH", CASE deed_type WHEN 'warranty' THEN 1 ELSE 0 END AS warranty, size AS subdiv_size, n_regionkey,
  CAST((year(DATE '1960-01-01' + CAST(day AS INTEGER)) - 1960) * 12 + month(DATE '1960-01-01' + CAST(day AS INTEGER)) - 1 AS INTEGER) AS month, CASE WHEN bdrms = 1 THEN 1 ELSE 0 END AS bdrms_2
 FROM r JOIN n USING (FIPS, sub) LEFT JOIN nation ON FIPS = '0' || (1001 + n_nationkey)""")
def regression_table(spark, sf):
    return analysis_rows(spark, sf).select("TransId", "geoid", "HOA_NEIGH", "warranty", "subdiv_size", "n_regionkey", "month", "bdrms_2")


@query()
def national_models(spark, sf):
    """Two treatments under two absorbed effects with clustered errors; the estimator is checked against NumPy in the tests."""
    rows = materialize(analysis_rows(spark, sf), "analysis")
    fits = effects.national_models(rows, "lprice", ["lba", "ageAtSale", "warranty"], "tract", "month", "FIPS")
    return fits.select("model", "term", r6("coef", 4).alias("coef"), r6("se", 4).alias("se"), "n")
