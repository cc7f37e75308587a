"""Spatial joins, overlays, density clusters and the inferred status."""

from pyspark.sql import functions as F

from checks.roles import query, r6, table
from plotmark.operators import overlay, spatial
from plotmark.operators.dbscan import dbscan as cluster_points
from plotmark.plans.listings import listing_fee_by_polygon
from plotmark.plans.neighbourhoods import infer_neighbourhood_status

SQL_POINTS = "pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"
# 25 tiles, one per nation, over most of the points' range.
SQL_TILES = """tiles AS (SELECT n_nationkey AS poly_id, -0.41::DOUBLE + 0.154::DOUBLE * (n_nationkey % 5) AS min_x,
  -0.41::DOUBLE + 0.154::DOUBLE * (n_nationkey // 5) AS min_y, -0.41::DOUBLE + 0.154::DOUBLE * (n_nationkey % 5 + 1) AS max_x,
  -0.41::DOUBLE + 0.154::DOUBLE * (n_nationkey // 5 + 1) AS max_y FROM nation)"""
INSIDE = "x >= min_x AND x < max_x AND y >= min_y AND y < max_y"


def points(spark, sf):
    at = [F.element_at("embedding", i + 1).cast("double").alias("xyz"[i]) for i in range(3)]
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *at, "label")


def tiles(spark, sf):
    k = F.col("n_nationkey")
    row = F.floor(k / 5)
    def edge(n):
        return F.lit(-0.41) + F.lit(0.154) * n
    return table(spark, sf, "nation").select(
        k.alias("poly_id"), edge(k % 5).alias("min_x"), edge(row).alias("min_y"), edge(k % 5 + 1).alias("max_x"), edge(row + 1).alias("max_y")
    )


def tile_rings(spark, sf):
    corners = [F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    return tiles(spark, sf).select("poly_id", spatial.rectangle_ring(*corners).alias("ring"))


@query(f"WITH {SQL_POINTS}, {SQL_TILES} SELECT id, min(poly_id) AS poly_id FROM pts LEFT JOIN tiles ON {INSIDE} GROUP BY 1")
def point_in_rect(spark, sf):
    """Keep-all join: points outside every polygon stay with a null polygon."""
    return spatial.points_in_polygons(points(spark, sf), tile_rings(spark, sf)).select("id", "poly_id")


@query(f"""WITH {SQL_POINTS}, {SQL_TILES} SELECT id, min(poly_id) AS poly_id FROM pts JOIN tiles
 ON {INSIDE} AND (x - min_x) / (max_x - min_x) + (y - min_y) / (max_y - min_y) < 1 GROUP BY 1""")
def point_in_triangle(spark, sf):
    def corner(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("min_x", "max_y"))
    shapes = tiles(spark, sf).select("poly_id", ring.alias("ring"))
    return spatial.points_in_polygons(points(spark, sf), shapes, "inner").select("id", "poly_id")


SQL_BOXES = """boxes AS (SELECT s_suppkey AS a, (s_suppkey * 37 % 100) / 120.0::DOUBLE - 0.41 AS min_x, (s_suppkey * 61 % 100) / 120.0::DOUBLE - 0.41 AS min_y,
  (s_suppkey * 37 % 100) / 120.0::DOUBLE - 0.41 + (1 + s_suppkey % 7) / 25.0::DOUBLE AS max_x,
  (s_suppkey * 61 % 100) / 120.0::DOUBLE - 0.41 + (1 + s_suppkey % 3) / 50.0::DOUBLE AS max_y FROM supplier)"""
SHARED = "(least(b.max_x, t.max_x) - greatest(b.min_x, t.min_x)) * (least(b.max_y, t.max_y) - greatest(b.min_y, t.min_y))"
MEET = "least(b.max_x, t.max_x) > greatest(b.min_x, t.min_x) AND least(b.max_y, t.max_y) > greatest(b.min_y, t.min_y)"


def boxes(spark, sf):
    k = F.col("s_suppkey")
    x, y = (k * 37 % 100) / 120.0 - 0.41, (k * 61 % 100) / 120.0 - 0.41
    return table(spark, sf, "supplier").select(
        k.alias("a"), x.alias("min_x"), y.alias("min_y"), (x + (1 + k % 7) / 25.0).alias("max_x"), (y + (1 + k % 3) / 50.0).alias("max_y")
    )


@query(f"WITH {SQL_BOXES}, {SQL_TILES} SELECT a, poly_id, round({SHARED}, 6) AS area FROM boxes b JOIN tiles t ON {MEET}")
def bbox_intersection(spark, sf):
    found = spatial.bbox_overlay(boxes(spark, sf), tiles(spark, sf), "a", "poly_id")
    return found.withColumn("area", r6("area"))


@query(f"WITH {SQL_BOXES}, {SQL_TILES} SELECT a, poly_id, round({SHARED}, 6) AS area FROM boxes b JOIN tiles t ON {MEET}")
def polygon_overlaps(spark, sf):
    corners = spatial.rectangle_ring(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]).alias("ring")
    a, b = boxes(spark, sf).select("a", corners), tiles(spark, sf).select("poly_id", corners)
    return overlay.polygon_overlaps(a, b, "a", "poly_id").withColumn("area", r6("area"))


@query(f"""WITH {SQL_BOXES}, {SQL_TILES}, c AS (SELECT a, sum({SHARED}) AS s FROM boxes b JOIN tiles t ON {MEET} GROUP BY 1)
 SELECT a, round((max_x - min_x) * (max_y - min_y) - coalesce(s, 0), 6) + 0.0 AS area FROM boxes LEFT JOIN c USING (a)
 WHERE (max_x - min_x) * (max_y - min_y) - coalesce(s, 0) > 1e-12 * (max_x - min_x) * (max_y - min_y)""")
def bbox_difference(spark, sf):
    found = spatial.bbox_overlay(boxes(spark, sf), tiles(spark, sf), "a", "poly_id", "difference")
    return found.withColumn("area", r6("area"))


@query(f"""WITH {SQL_BOXES}, {SQL_TILES}, m AS (SELECT poly_id, greatest(b.min_x, t.min_x) AS x0, least(b.max_x, t.max_x) AS x1, greatest(b.min_y, t.min_y) AS y0,
   least(b.max_y, t.max_y) AS y1 FROM boxes b JOIN tiles t ON {MEET}),
 xs AS (SELECT poly_id, x AS xa, lead(x) OVER (PARTITION BY poly_id ORDER BY x) AS xb FROM (SELECT DISTINCT poly_id, unnest([x0, x1]) AS x FROM m)),
 ys AS (SELECT poly_id, y AS ya, lead(y) OVER (PARTITION BY poly_id ORDER BY y) AS yb FROM (SELECT DISTINCT poly_id, unnest([y0, y1]) AS y FROM m)),
 u AS (SELECT poly_id, sum((xb - xa) * (yb - ya)) AS s FROM xs JOIN ys USING (poly_id) WHERE EXISTS (SELECT 1 FROM m
   WHERE m.poly_id = xs.poly_id AND x0 <= xa AND x1 >= xb AND y0 <= ya AND y1 >= yb) GROUP BY 1)
 SELECT poly_id, round((max_x - min_x) * (max_y - min_y) - coalesce(s, 0), 6) + 0.0 AS area FROM tiles LEFT JOIN u USING (poly_id)""")
def bbox_difference_of_overlapping(spark, sf):
    """What the boxes, which overlap each other, leave of each tile."""
    found = spatial.bbox_overlay(tiles(spark, sf), boxes(spark, sf), "poly_id", "a", "difference", keep_covered=True)
    return found.withColumn("area", r6("area"))


def inner_ring(lo: float, hi: float):
    """A rectangle inside each tile, at these shares of its sides."""
    def at(side, share):
        return F.col(f"min_{side}") + share * (F.col(f"max_{side}") - F.col(f"min_{side}"))
    return spatial.rectangle_ring(at("x", lo), at("y", lo), at("x", hi), at("y", hi))


def edges_at(lo: float, hi: float) -> str:
    return " AND ".join(f"{s} >= min_{s} + {lo}::DOUBLE * (max_{s} - min_{s}) AND {s} < min_{s} + {hi}::DOUBLE * (max_{s} - min_{s})" for s in "xy")


@query(f"WITH {SQL_POINTS}, {SQL_TILES} SELECT id, min(poly_id) AS poly_id FROM pts LEFT JOIN tiles ON {INSIDE} AND NOT ({edges_at(0.25, 0.75)}) GROUP BY 1")
def point_in_polygon_with_hole(spark, sf):
    rings = F.array(spatial.rectangle_ring(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]), inner_ring(0.25, 0.75))
    return spatial.points_in_polygons(points(spark, sf), tiles(spark, sf).select("poly_id", rings.alias("ring"))).select("id", "poly_id")


@query(f"WITH {SQL_POINTS}, {SQL_TILES} SELECT id, min(poly_id) AS poly_id FROM pts JOIN tiles ON ({edges_at(0.0, 0.4)}) OR ({edges_at(0.5, 0.9)}) GROUP BY 1")
def point_in_polygon_of_two_parts(spark, sf):
    rings = F.array(inner_ring(0.0, 0.4), inner_ring(0.5, 0.9))
    return spatial.points_in_polygons(points(spark, sf), tiles(spark, sf).select("poly_id", rings.alias("ring")), "inner").select("id", "poly_id")


@query(f"""WITH {SQL_POINTS}, {SQL_TILES} SELECT poly_id, count(fee) AS flagged, count(*) AS total, round(count(fee) / count(*), 6) AS share,
 round(avg(fee), 6) AS fee_mean FROM (SELECT *, CASE WHEN label % 3 > 0 THEN 100 + z END AS fee FROM pts) JOIN tiles ON {INSIDE} GROUP BY 1""")
def listing_fee_by_area_polygon(spark, sf):
    listings = points(spark, sf).withColumn("fee", F.when(F.col("label") % 3 > 0, 100 + F.col("z")))
    found = listing_fee_by_polygon(listings, tile_rings(spark, sf), "x", "y", "fee", "poly_id")
    return found.select("poly_id", "flagged", "total", r6("share").alias("share"), r6("fee_mean").alias("fee_mean"))


def sql_clusters(x: str, y: str, z: str, source: str) -> str:
    """Labels by transitive closure over core neighbours; a border point takes the least core label."""
    return f"""p AS (SELECT id, {x} AS x, {y} AS y, {z} AS z FROM {source}),
 nb AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b
   ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1 + 1e-9),
 core AS (SELECT a FROM nb GROUP BY 1 HAVING count(*) >= 5),
 e AS (SELECT nb.a, nb.b FROM nb WHERE nb.a IN (SELECT a FROM core) AND nb.b IN (SELECT a FROM core)),
 reach(id, src) AS (SELECT a, a FROM core UNION SELECT e.b, r.src FROM reach r JOIN e ON e.a = r.id),
 lab AS (SELECT id, min(src) AS label FROM reach GROUP BY 1),
 border AS (SELECT nb.a AS id, min(lab.label) AS near FROM nb JOIN lab ON lab.id = nb.b GROUP BY 1),
 clusters AS (SELECT p.id, coalesce(lab.label, border.near, -1) AS cluster FROM p LEFT JOIN lab ON lab.id = p.id LEFT JOIN border ON border.id = p.id)"""


@query(f"WITH RECURSIVE {SQL_POINTS}, {sql_clusters('x / 0.04', 'y / 0.04', 'z / 0.04', 'pts')} SELECT id, cluster FROM clusters")
def dbscan(spark, sf):
    return cluster_points(points(spark, sf), "id", ["x", "y", "z"], 0.04, 5).select("id", "cluster")


HOUSES = f"""{SQL_POINTS}, homes AS (SELECT id, x, y, CAST(1960 + label * 2 AS BIGINT) AS built, CAST(label % 3 AS BIGINT) AS county,
  CASE WHEN id % 13 > 0 THEN 'S' || (id % 30) END AS sub, CASE WHEN id % 11 > 0 THEN CASE WHEN id * 7 % 10 < 6 THEN 1 ELSE 0 END END AS hoa FROM pts)"""


def bins(share: str) -> str:
    return f"CASE WHEN {share} >= 0.6 THEN 1 WHEN {share} >= 0.2 THEN 9 WHEN {share} >= 0 THEN 0 ELSE 10 END"


@query(f"""WITH RECURSIVE {HOUSES}, {sql_clusters('x / 0.05', 'y / 0.05', 'built / 2.0', 'homes')},
 cs AS (SELECT cluster, avg(hoa) AS share, count(*) AS n FROM clusters JOIN homes USING (id) WHERE cluster <> -1 GROUP BY 1),
 ss AS (SELECT county, sub, avg(hoa) AS share, count(*) AS n FROM homes WHERE sub IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
 yc AS (SELECT county, sub, built, row_number() OVER (PARTITION BY county, sub ORDER BY count(*) DESC, built) AS i FROM homes GROUP BY 1, 2, 3),
 j AS (SELECT h.id AS RowID, c.cluster, {bins('CASE WHEN cs.n >= 5 THEN cs.share END')} AS a, {bins('ss.share')} AS b,
   CASE WHEN ss.n IS NOT NULL THEN yc.built END AS YearBuilt_mode
   FROM homes h JOIN clusters c USING (id) LEFT JOIN cs USING (cluster) LEFT JOIN ss ON ss.county = h.county AND ss.sub = h.sub
   LEFT JOIN yc ON yc.county = h.county AND yc.sub = h.sub AND yc.i = 1)
 SELECT RowID, cluster, a AS hoa_cluster, b AS hoa_subdiv, CASE WHEN (a = 1 AND b <> 0) OR (b = 1 AND a <> 0) THEN 1
   WHEN (a = 0 AND b <> 1) OR (b = 0 AND a <> 1) THEN 0 ELSE 9 END AS hoa_neigh, YearBuilt_mode FROM j""")
def infer_status(spark, sf):
    k = F.col("id")
    homes = points(spark, sf).select(
        k.alias("RowID"), F.col("x").alias("PropertyAddressLongitude"), F.col("y").alias("PropertyAddressLatitude"),
        (1960 + F.col("label") * 2).cast("long").alias("YearBuilt"), (F.col("label") % 3).cast("long").alias("county"),
        F.when(k % 13 > 0, F.concat(F.lit("S"), (k % 30).cast("string"))).alias("LegalSubdivisionName"),
        F.when(k % 11 > 0, F.when(k * 7 % 10 < 6, 1).otherwise(0)).alias("hoa"),
    )
    return infer_neighbourhood_status(homes, radius=0.05)
