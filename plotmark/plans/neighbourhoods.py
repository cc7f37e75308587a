"""Neighbourhood status inferred from clusters and named subdivisions (C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plotmark.functions.status import cutoff_status, fuse_status
from plotmark.operators.areas import group_mode, group_share
from plotmark.operators.dbscan import dbscan
from plotmark.operators.skew import attach_groups
from plotmark.plans import codes
from plotmark.session import materialize

DROPPED = "drop"


def infer_neighbourhood_status(
    parcels: DataFrame,
    *,
    radius: float = codes.CLUSTER_RADIUS,
    min_pts: int = codes.CLUSTER_MIN,
    year_weight: float = codes.YEAR_WEIGHT,
    lo: float = 0.2,
    hi: float = 0.6,
    min_n: int = 5,
    metric: bool = False,
    keep_dropped_mode: bool = False,
) -> DataFrame:
    """(RowID, cluster, hoa_cluster, hoa_subdiv, hoa_neigh, YearBuilt_mode).

    Houses are neighbours within ``radius`` degrees, where a year between building
    dates counts as ``year_weight`` radii; ``metric`` shortens degrees of longitude by
    latitude. ``keep_dropped_mode`` also gives the modal year of the houses that
    belong to no usable subdivision, pooled by county.
    """
    lon, lat = "PropertyAddressLongitude", "PropertyAddressLatitude"
    known = parcels.dropna(subset=[lon, lat, "county", "YearBuilt"]).select(
        "RowID", lon, lat, "county", "YearBuilt", "LegalSubdivisionName", "hoa"
    )
    if metric:
        known = known.withColumn("_lon", F.col(lon) * F.cos(F.radians(F.col(lat))))
    x = "_lon" if metric else lon
    labelled = dbscan(known, "RowID", [x, lat, "YearBuilt"], [radius, radius, 1 / year_weight], min_pts)
    labelled = materialize(labelled.drop(x, lon, lat), "labelled")

    noise = F.col("cluster") == F.lit(-1).cast(labelled.schema["cluster"].dataType)
    df = group_share(labelled, ["cluster"], "hoa", "_cluster_share", min_n, exclude=noise)
    df = df.withColumn("hoa_cluster", cutoff_status("_cluster_share", lo, hi))

    named = ["county", "LegalSubdivisionName"]
    usable = F.col("_size") >= min_n
    subdivisions = (
        labelled.dropna(subset=named)
        .filter(F.col("LegalSubdivisionName") != DROPPED)
        .groupBy(*named)
        .agg(F.count("*").alias("_size"), F.avg("hoa").alias("_subdiv_share"))
        .join(group_mode(labelled, named, "YearBuilt", "YearBuilt_mode").drop("group_n"), named)
        .filter(usable)
    )
    df = attach_groups(df, subdivisions, named, "_size")
    df = df.withColumn("hoa_subdiv", cutoff_status("_subdiv_share", lo, hi))
    if keep_dropped_mode:
        pooled = F.when(F.col("YearBuilt_mode").isNull(), F.col("county")).alias("county")
        modes = group_mode(df.select(pooled, "YearBuilt"), ["county"], "YearBuilt", "_pooled_mode")
        df = attach_groups(df, modes, ["county"], "group_n")
        df = df.withColumn("YearBuilt_mode", F.coalesce("YearBuilt_mode", "_pooled_mode"))
    df = df.withColumn("hoa_neigh", fuse_status("hoa_cluster", "hoa_subdiv"))
    return df.select("RowID", "cluster", "hoa_cluster", "hoa_subdiv", "hoa_neigh", "YearBuilt_mode")
