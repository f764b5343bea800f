"""Origins of distances: found, kept, compared, and the analyses recomputed for another one."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rookery.functions.text import strip
from rookery.operators import distributions as dist, location as loc
from rookery.rules import Rules
from rookery.session import cut

FIELDS = ("origin_id", "name", "longitude", "latitude")
#: Degrees by which two coordinates of one place differ at most.
SAME_DEGREES = 1e-6


def from_geocode(df: DataFrame, body: str, origin_id: Column, name: Column) -> DataFrame:
    """``origin_id``, ``name``, ``longitude``, ``latitude`` of the first hit of each answer of a geocoding service.

    Answers that aren't JSON, failed (status other than 1), or whose first hit has no "longitude,latitude" give no row; a hit
    without a name takes ``name``.
    """
    a = F.from_json(body, "struct<status:string,geocodes:array<struct<location:string,formatted_address:string>>>")
    d = df.select(origin_id.alias("origin_id"), name.alias("_name"), a.alias("a")).where("a.status = '1'").withColumn("g", F.get("a.geocodes", F.lit(0)))
    at = lambda i: strip(F.get(F.split("g.location", ",", 2), F.lit(i))).try_cast("double")
    return d.select("origin_id", F.coalesce(F.nullif(F.col("g.formatted_address"), F.lit("")), "_name").alias("name"), at(0).alias("longitude"), at(1).alias("latitude")).dropna(subset=["longitude", "latitude"])


def from_distances(df: DataFrame, order: str, default: tuple[str, str] = ("origin", "Origin")) -> DataFrame:
    """The origin in the first row, by ``order``, that has both coordinates; no row if there is none or columns are missing."""
    need = ["origin_id", "origin_name", "origin_longitude", "origin_latitude"]
    if not set(need) <= set(df.columns):
        return df.sparkSession.createDataFrame([], "origin_id string, name string, longitude double, latitude double")
    d = df.where("origin_longitude is not null and origin_latitude is not null and not isnan(origin_longitude) and not isnan(origin_latitude)").orderBy(order).limit(1)
    text = lambda c, x: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(x))
    return d.select(text("origin_id", default[0]).alias("origin_id"), text("origin_name", default[1]).alias("name"), F.col("origin_longitude").cast("double").alias("longitude"), F.col("origin_latitude").cast("double").alias("latitude"))


def signature(name: str, lon: str, lat: str) -> Column:
    return F.format_string("%s · %.6f,%.6f", name, lon, lat)


def same_place(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return (F.abs(lon1 - lon2) < SAME_DEGREES) & (F.abs(lat1 - lat2) < SAME_DEGREES)


def save_origin(origin: dict[str, object], path: str) -> None:
    """Keep an origin as a JSON file on the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({k: origin[k] for k in FIELDS}, f, ensure_ascii=False, indent=2)


def load_origin(path: str, default: tuple[str, str] = ("origin", "Origin")) -> dict[str, object] | None:
    """The origin kept in a file; None if the file is missing, broken or has no coordinates."""
    try:
        with open(path, encoding="utf-8") as f:
            o = json.load(f)
        return {"origin_id": str(o.get("origin_id") or default[0]), "name": str(o.get("name") or default[1]), "longitude": float(o["longitude"]), "latitude": float(o["latitude"])}
    except (OSError, ValueError, TypeError, KeyError, AttributeError):
        return None


def marker(spark: SparkSession, origin: dict[str, object]) -> DataFrame:
    """The origin as one row that stands beside listings on a map."""
    return spark.createDataFrame([(f"origin: {origin['name']}", float(origin["longitude"]), float(origin["latitude"]), "origin", 0)], "title string, longitude double, latitude double, distance_bucket string, distance_m int")


def recompute(quality: DataFrame, lon: float, lat: float, rules: Rules = Rules()) -> DataFrame:
    """Distances, prices by distance and neighbours of quality rows, for an origin given at call time."""
    d = cut(dist.origin_distances(quality.where("can_analyze_map"), lon, lat, rules))
    c = cut(d.where("tier <> 'blocked' and can_analyze_price and can_analyze_area_price"))
    fields = ["listing_id", "community_name", "longitude", "latitude", "distance_bucket", "rent_price", "rent_per_sqm", "apartment_like", "possible_duplicate"]
    p = dist.price_area_rows(c.select(*fields), "distance_bucket", "community_name", rules)
    v = loc.location_value(c.select(*fields), rules)
    out = d.select("listing_id", "distance_m", "distance_bucket", "tier")
    out = out.join(p.select("listing_id", "price_median", "price_percentile", "price_good", "price_expensive", "rps_good", "rps_expensive"), "listing_id", "left")
    return out.join(v.select("listing_id", "nearby_n", "nearby_price_median", "below_nearby_median", "nearby_good_value", "nearby_expensive"), "listing_id", "left")
