"""Queries of the general data operators: nearby points, snapshot changes and attribute history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rookery.operators.bitemporal import bitemporal_ledger
from rookery.operators.near import containing_regions, near_pairs, near_points
from rookery.operators.snapshots import snapshot_changes
from rookery.sources import table

NEAR_M = 80.0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings at most 80 m apart."""
    df = table(spark, sf_dir, "rental_listings", "listing_id", "longitude", "latitude")
    return near_pairs(df, "listing_id", "longitude", "latitude", NEAR_M).select(F.col("a").alias("listing_id_a"), F.col("b").alias("listing_id_b"))


def p1_between_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of one source at most 80 m from those of the other sources: two tables in one search."""
    df = table(spark, sf_dir, "rental_listings", "listing_id", "source", "longitude", "latitude")
    one, others = df.where("source = 'ugc_c'"), df.where("source <> 'ugc_c'")
    return near_points(one, "listing_id", others, "listing_id", "longitude", "latitude", NEAR_M).select(F.col("a").alias("listing_id"), F.col("b").alias("other_id"))


def p1_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts as diamonds around the middle of their listings, and the listings of any district that lie in them."""
    df = table(spark, sf_dir, "rental_listings", "listing_id", "city", "district", "longitude", "latitude")
    ok = df.where("not isnan(longitude) and not isnan(latitude) and longitude between -180 and 180 and latitude between -90 and 90 and not (longitude = 0 and latitude = 0)").distinct()
    box = ok.where("district is not null").groupBy("city", "district").agg(*[f(c).alias(n) for c, k in (("longitude", "x"), ("latitude", "y")) for f, n in ((F.min, f"{k}0"), (F.max, f"{k}1"))])
    corner = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    mx, my = "(x0 + x1) / 2", "(y0 + y1) / 2"
    ring = F.array(corner("x0 - 0.0001", my), corner(mx, "y0 - 0.0001"), corner("x1 + 0.0001", my), corner(mx, "y1 + 0.0001"))
    regions = box.select(F.concat_ws("|", "city", "district").alias("region"), ring.alias("ring"))
    return containing_regions(df, "listing_id", "longitude", "latitude", regions, "region", "ring").select(F.col("point").alias("listing_id"), "region")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings added, removed or changed between consecutive snapshots."""
    df = table(spark, sf_dir, "listing_snapshots", "snapshot_date", "source", "source_listing_id", "title", "community_name", "district", "rent_price", "status", "last_seen_at", "delivered_at")
    out = snapshot_changes(df, "snapshot_date", ["source", "source_listing_id"], ["title", "community_name", "district", "rent_price", "status"], "last_seen_at", stripped=("title",), ties=("delivered_at",))
    return out.withColumn("snapshot_date", F.date_format("snapshot_date", "yyyy-MM-dd"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "listing_observations", "source", "source_listing_id", "observed_at", "crawl_run_id", "rent_price", "availability_status")
    return bitemporal_ledger(df, ["source", "source_listing_id"], "observed_at", "crawl_run_id", ["rent_price", "availability_status"], {"availability_status": ["unknown"]})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each version of a listing's standing rent and status begins."""
    return _ledger(spark, sf_dir).where("opens_version").select("source", "source_listing_id", F.col("valid_from").alias("valid_from_us"))


def p7_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bitemporal ledger, superseded rows included."""
    return _ledger(spark, sf_dir).select("source", "source_listing_id", "rent_price", "availability_status", F.col("valid_from").alias("valid_from_us"), F.col("valid_to").alias("valid_to_us"), "recorded_from", "recorded_to", "superseded", "opens_version")


QUERIES = {"p1_found": p1_found, "p1_between_sources": p1_between_sources, "p1_regions": p1_regions, "p5_found": p5_found, "p7_found": p7_found, "p7_ledger": p7_ledger}

ORACLE = {
    "p1_found": """
WITH p AS (
  SELECT DISTINCT listing_id AS i, longitude AS x, latitude AS y FROM rental_listings
  WHERE longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90
    AND NOT isnan(longitude) AND NOT isnan(latitude) AND NOT (longitude = 0 AND latitude = 0))
SELECT DISTINCT a.i AS listing_id_a, b.i AS listing_id_b
FROM p a JOIN p b ON a.i < b.i AND b.y BETWEEN a.y - 0.001 AND a.y + 0.001
WHERE 2 * 6371008.8 * asin(sqrt(least(1, power(sin(radians(b.y - a.y) / 2), 2)
      + cos(radians(a.y)) * cos(radians(b.y)) * power(sin(radians(b.x - a.x) / 2), 2)))) <= 80
""",
    "p1_between_sources": """
WITH p AS (
  SELECT DISTINCT listing_id AS i, source = 'ugc_c' AS s, longitude AS x, latitude AS y FROM rental_listings
  WHERE longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90
    AND NOT isnan(longitude) AND NOT isnan(latitude) AND NOT (longitude = 0 AND latitude = 0))
SELECT DISTINCT a.i AS listing_id, b.i AS other_id
FROM p a JOIN p b ON a.s AND NOT b.s AND b.y BETWEEN a.y - 0.001 AND a.y + 0.001
WHERE 2 * 6371008.8 * asin(sqrt(least(1, power(sin(radians(b.y - a.y) / 2), 2)
      + cos(radians(a.y)) * cos(radians(b.y)) * power(sin(radians(b.x - a.x) / 2), 2)))) <= 80
""",
    "p1_regions": """
WITH p AS (
  SELECT DISTINCT listing_id AS i, city, district, longitude AS x, latitude AS y FROM rental_listings
  WHERE longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90
    AND NOT isnan(longitude) AND NOT isnan(latitude) AND NOT (longitude = 0 AND latitude = 0)),
r AS (SELECT concat_ws('|', city, district) AS region, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my,
             (max(x) - min(x)) / 2 + 0.0001 AS rx, (max(y) - min(y)) / 2 + 0.0001 AS ry FROM p WHERE district IS NOT NULL GROUP BY city, district)
SELECT DISTINCT i AS listing_id, region FROM p JOIN r ON abs(x - mx) / rx + abs(y - my) / ry < 1
""",
    "p7_ledger": """
WITH o AS (
  SELECT source AS s, source_listing_id AS i, epoch_us(observed_at) AS v, crawl_run_id AS run, rent_price AS r, nullif(availability_status, 'unknown') AS a,
         row_number() OVER (PARTITION BY source, source_listing_id, observed_at
                            ORDER BY crawl_run_id NULLS LAST, rent_price NULLS FIRST, nullif(availability_status, 'unknown') NULLS FIRST) AS n
  FROM listing_observations WHERE observed_at IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY s, i ORDER BY run NULLS LAST, v) AS k FROM o WHERE n = 1),
f AS (SELECT s, i, v, last_value(r IGNORE NULLS) OVER w AS r, last_value(a IGNORE NULLS) OVER w AS a FROM r WINDOW w AS (PARTITION BY s, i ORDER BY v)),
g AS (SELECT s, i, v, row_number() OVER w = 1 OR r IS DISTINCT FROM lag(r) OVER w OR a IS DISTINCT FROM lag(a) OVER w AS opens FROM f WINDOW w AS (PARTITION BY s, i ORDER BY v)),
-- the nearest moments on both sides that were recorded before, and who splits what they leave
nb AS (SELECT x.s, x.i, x.v, max(y.v) FILTER (y.v < x.v) AS pv, min(y.v) FILTER (y.v > x.v) AS sv
       FROM r x LEFT JOIN r y ON x.s IS NOT DISTINCT FROM y.s AND x.i IS NOT DISTINCT FROM y.i AND y.k < x.k GROUP BY ALL),
c AS (SELECT r.*, nb.pv, nb.sv FROM r JOIN nb ON r.s IS NOT DISTINCT FROM nb.s AND r.i IS NOT DISTINCT FROM nb.i AND r.v = nb.v),
ch AS (SELECT x.s, x.i, x.v, min(y.k) FILTER (y.v > x.v AND (x.sv IS NULL OR y.v < x.sv)) AS rk, min(y.k) FILTER (y.v < x.v AND y.v > x.pv) AS lk
       FROM c x LEFT JOIN r y ON x.s IS NOT DISTINCT FROM y.s AND x.i IS NOT DISTINCT FROM y.i AND y.k > x.k GROUP BY ALL),
e AS (SELECT c.*, ch.rk, ch.lk, right_.run AS rrun, left_.run AS lrun, p.r AS pr, p.a AS pa, g.opens
      FROM c JOIN ch ON c.s IS NOT DISTINCT FROM ch.s AND c.i IS NOT DISTINCT FROM ch.i AND c.v = ch.v
      JOIN g ON c.s IS NOT DISTINCT FROM g.s AND c.i IS NOT DISTINCT FROM g.i AND c.v = g.v
      LEFT JOIN r right_ ON c.s IS NOT DISTINCT FROM right_.s AND c.i IS NOT DISTINCT FROM right_.i AND right_.k = ch.rk
      LEFT JOIN r left_ ON c.s IS NOT DISTINCT FROM left_.s AND c.i IS NOT DISTINCT FROM left_.i AND left_.k = ch.lk
      LEFT JOIN r p ON c.s IS NOT DISTINCT FROM p.s AND c.i IS NOT DISTINCT FROM p.i AND p.v = c.pv)
SELECT s AS source, i AS source_listing_id, r AS rent_price, a AS availability_status, v AS valid_from_us, sv AS valid_to_us, run AS recorded_from, rrun AS recorded_to, rk IS NOT NULL AS superseded, opens AS opens_version FROM e
UNION ALL
SELECT s, i, pr, pa, pv, v, run, lrun, lk IS NOT NULL, NULL FROM e WHERE pv IS NOT NULL
""",
    "p5_found": r"""
WITH r AS (
  SELECT snapshot_date AS d, source AS s, source_listing_id AS i, regexp_replace(title, '^[\s\x{3000}\x{00A0}\x{200B}]+|[\s\x{3000}\x{00A0}\x{200B}]+$', '', 'g') AS t,
         community_name AS c, district AS x, rent_price AS p, status AS st,
         row_number() OVER (PARTITION BY snapshot_date, source, source_listing_id ORDER BY last_seen_at DESC NULLS LAST, delivered_at DESC NULLS LAST) AS n
  FROM listing_snapshots WHERE snapshot_date IS NOT NULL),
k AS (SELECT * FROM r WHERE n = 1),
days AS (SELECT d, lag(d) OVER (ORDER BY d) AS p FROM (SELECT DISTINCT d FROM k)),
o AS (SELECT days.d, k.s, k.i, k.t, k.c, k.x, k.p, k.st FROM days JOIN k ON k.d = days.p),
w AS (SELECT days.d, k.s, k.i, k.t, k.c, k.x, k.p, k.st FROM days JOIN k ON k.d = days.d WHERE days.p IS NOT NULL)
SELECT strftime(coalesce(w.d, o.d), '%Y-%m-%d') AS snapshot_date, coalesce(w.s, o.s) AS source, coalesce(w.i, o.i) AS source_listing_id,
       CASE WHEN o.d IS NULL THEN 'added' WHEN w.d IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM w FULL JOIN o ON w.d = o.d AND w.s IS NOT DISTINCT FROM o.s AND w.i IS NOT DISTINCT FROM o.i
WHERE o.d IS NULL OR w.d IS NULL OR w.t IS DISTINCT FROM o.t OR w.c IS DISTINCT FROM o.c OR w.x IS DISTINCT FROM o.x
   OR w.p IS DISTINCT FROM o.p OR w.st IS DISTINCT FROM o.st
""",
    "p7_found": """
WITH o AS (
  SELECT source AS s, source_listing_id AS i, epoch_us(observed_at) AS v, rent_price AS r, nullif(availability_status, 'unknown') AS a,
         row_number() OVER (PARTITION BY source, source_listing_id, observed_at
                            ORDER BY crawl_run_id NULLS LAST, rent_price NULLS FIRST, nullif(availability_status, 'unknown') NULLS FIRST) AS n
  FROM listing_observations WHERE observed_at IS NOT NULL),
f AS (SELECT s, i, v, last_value(r IGNORE NULLS) OVER w AS r, last_value(a IGNORE NULLS) OVER w AS a
      FROM o WHERE n = 1 WINDOW w AS (PARTITION BY s, i ORDER BY v)),
g AS (SELECT s, i, v, r, a, lag(r) OVER w AS pr, lag(a) OVER w AS pa, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY s, i ORDER BY v))
SELECT s AS source, i AS source_listing_id, v AS valid_from_us FROM g
WHERE n = 1 OR r IS DISTINCT FROM pr OR a IS DISTINCT FROM pa
""",
}
