"""Command line over a folder of Parquet tables: scans and parses captured pages, runs the analyses, writes CSV and summaries.

    python -m rookery.cli quality --tables DIR --out DIR
    python -m rookery.cli distances --tables DIR --out DIR --lon 121.5 --lat 31.2

Fetching from sites is out of scope: ``pages`` and ``ingest`` start from captured files. Wrong options end with status 2.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rookery import sinks
from rookery.functions.text import clean_text
from rookery.operators import distributions as dist, history as hist, location as loc, origins, quality as qual, store
from rookery.rules import Rules
from rookery.session import cut, local_session, ship
from rookery.sources import pages, table

LISTING_SCHEMA = "source string, source_listing_id string, title string, rent_price int, area_sqm double, district string, longitude double, latitude double, seen_us long"


def _quality(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    x = table(spark, args.tables, "rental_listings")
    if args.source:
        x = x.where(F.col("source") == args.source)
    num = lambda c: F.when(~F.isnan(c), F.col(c))
    x = x.withColumns({"listing_id": F.col("listing_id").cast("string"), "area_sqm": num("area_sqm"), "longitude": num("longitude"), "latitude": num("latitude")})
    return cut(qual.quality_rows(x.dropDuplicates(["listing_id"]), args.rules))


def _candidates(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    d = dist.origin_distances(_quality(spark, args).where("can_analyze_map"), args.lon, args.lat, args.rules)
    fields = ["listing_id", "community_name", "longitude", "latitude", "distance_m", "distance_bucket", "rent_price", "rent_per_sqm", "apartment_like", "possible_duplicate"]
    return cut(d.where("tier <> 'blocked' and can_analyze_price and can_analyze_area_price").select(*fields))


def _export(args: argparse.Namespace, name: str, rows: DataFrame, summary: DataFrame, order: list[str]) -> None:
    """Rows as CSV in their order, the summary as one JSON object."""
    sinks.write_csv(rows, f"{args.out}/{name}", order=order)
    sinks.as_json(summary).write.mode("overwrite").text(f"{args.out}/{name}_summary")


def quality(spark: SparkSession, args: argparse.Namespace) -> None:
    q = _quality(spark, args)
    _export(args, "quality", q.select("listing_id", "title", "rent_price", "area_sqm", "rent_per_sqm", *qual.HAS, *qual.CAPABILITIES, *qual.RISKS, "tier", "notes"), qual.quality_summary(q), ["listing_id"])


def distances(spark: SparkSession, args: argparse.Namespace) -> None:
    d = cut(dist.origin_distances(_quality(spark, args).where("can_analyze_map"), args.lon, args.lat, args.rules).select("listing_id", "title", "longitude", "latitude", "distance_m", "distance_bucket"))
    n = d.agg(F.count(F.lit(1)).alias("total"), F.struct(*[F.count_if(F.col("distance_bucket") == b).alias(b) for b in args.rules.bucket_names]).alias("buckets"))
    _export(args, "distances", d, n, ["listing_id"])


def price_area(spark: SparkSession, args: argparse.Namespace) -> None:
    p = cut(dist.price_area_rows(_candidates(spark, args), "distance_bucket", "community_name", args.rules))
    labels = [f"{s}_{x}" for s in ("price", "rps") for x in ("good", "expensive", "low_outlier", "high_outlier")]
    by = p.groupBy("distance_bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("distance_bucket", "n")))).alias("buckets"))  # four
    _export(args, "price_area", p, by.crossJoin(p.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(c) for c in (*labels, "apartment_like", "possible_duplicate")])), ["listing_id"])


def location_value(spark: SparkSession, args: argparse.Namespace) -> None:
    v = cut(loc.location_value(_candidates(spark, args), dataclasses.replace(args.rules, nearby_m=args.radius)))
    flags = [c for c, t in v.dtypes if t == "boolean"]
    _export(args, "location_value", v, v.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(c) for c in flags]), ["listing_id"])


def clusters(spark: SparkSession, args: argparse.Namespace) -> None:
    c = cut(loc.density_clusters(_quality(spark, args).where("can_analyze_map"), "listing_id", dataclasses.replace(args.rules, eps_m=args.eps, min_samples=args.min_samples)))
    sizes = c.where("cluster <> 'noise'").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "cluster").limit(10).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "cluster"))).alias("_t"))
    s = sizes.agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.median("n").alias("median_size"))
    names = top.select(F.transform("_t", lambda x: F.struct(x["cluster"].alias("cluster"), (-x["minus"]).alias("n"))).alias("top"))
    _export(args, "clusters", c, c.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("cluster") == "noise").alias("noise")).crossJoin(s).crossJoin(names), ["listing_id"])  # one row each


def history(spark: SparkSession, args: argparse.Namespace) -> None:
    o = table(spark, args.tables, "listing_observations", *hist.KEYS, "observed_at", "crawl_run_id", "rent_price", "availability_status").distinct()
    tie = [F.coalesce("crawl_run_id", F.lit(1 << 30)), F.coalesce("rent_price", F.lit(-1)), F.coalesce("availability_status", F.lit(""))]
    h = cut(hist.price_history(o, hist.KEYS, "observed_at", "rent_price", tie))
    s = h.agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("delta") != 0).alias("changes"), F.count_if(F.col("delta") < 0).alias("drops"), F.count_if(F.col("delta") > 0).alias("rises"))
    _export(args, "history", h, s, [*hist.KEYS, "observed_at"])


def origin(spark: SparkSession, args: argparse.Namespace) -> None:
    """An origin out of the first usable captured answer of a geocoding service, kept as a file."""
    body = pages.read_captured(spark, args.captured, "*.json")
    got = origins.from_geocode(body, "body", F.lit(args.id), F.lit(args.name)).limit(1).collect()
    if not got:
        raise ValueError("no usable place in the captured answers")
    origins.save_origin(got[0].asDict(), args.file)


def summaries(spark: SparkSession, args: argparse.Namespace) -> None:
    """Title, links and kind of each captured page."""
    p = pages.read_captured(spark, args.captured)
    s = pages.page_summary(p.withColumn("base", F.lit(args.base)), "name", "body", "base", args.links).join(p.select("name", pages.page_kinds(F.col("body")).alias("kind")), "name")
    sinks.write_csv(s.select("name", "title", "bytes", "links", "kind.*"), f"{args.out}/pages", order=["name"])


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    """Captured API pages put into the stored table of listings; nothing is written in a dry run."""
    p = pages.read_captured(spark, args.captured, "*.json")
    i = pages.api_items(p, "body").where("item_id rlike '^[0-9]+$' and address <> ''")
    rows = i.select(F.lit(args.source or "api").alias("source"), F.col("item_id").alias("source_listing_id"), clean_text(F.col("address")).alias("title"), F.col("rent").alias("rent_price"), F.lit(None).cast("double").alias("area_sqm"), F.col("district_en").alias("district"), "longitude", "latitude", F.unix_micros("login_at").alias("seen_us"), F.struct("name", "item_id").alias("seq"))
    print(f"{rows.count()} listings")
    if not args.dry_run:
        store.upsert_store(spark, f"{args.out}/listings", LISTING_SCHEMA, rows, ["source", "source_listing_id"], "seq", "seen_us")


def sources(spark: SparkSession, args: argparse.Namespace) -> None:
    table(spark, args.tables, "rental_listings", "source").groupBy("source").count().orderBy("source").show(truncate=False)


COMMANDS = {"sources": sources, "pages": summaries, "ingest": ingest, "quality": quality, "origin": origin, "distances": distances, "price-area": price_area, "location-value": location_value, "clusters": clusters, "history": history}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rookery", description="Analyses of marketplace listings")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("--out", default="out")
        c.add_argument("--source", help="only listings of this source")
        if name in ("pages", "ingest", "origin"):
            c.add_argument("--captured", required=True, help="folder of captured files")
        else:
            c.add_argument("--tables", required=True, help="folder of Parquet tables")
        if name in ("distances", "price-area", "location-value"):
            c.add_argument("--lon", type=float, required=True)
            c.add_argument("--lat", type=float, required=True)
    of = sub.choices
    of["location-value"].add_argument("--radius", type=float, default=1000.0)
    of["clusters"].add_argument("--eps", type=float, default=800.0)
    of["clusters"].add_argument("--min-samples", type=int, default=5)
    of["pages"].add_argument("--base", default="")
    of["pages"].add_argument("--links", type=int, default=20)
    of["ingest"].add_argument("--dry-run", action="store_true")
    for option, default in (("--id", "origin"), ("--name", "Origin"), ("--file", "origin.json")):
        of["origin"].add_argument(option, default=default)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, rules: Rules = Rules()) -> int:
    args = parser().parse_args(argv)
    args.rules = rules
    spark = spark or local_session(app="rookery")
    ship(spark)
    try:
        COMMANDS[args.command](spark, args)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
