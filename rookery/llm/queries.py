"""Queries of this subpackage by name; SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rookery.llm.addresses import building_classes, same_building
from rookery.llm.entities import entry_candidates, match_records, positive, rooms
from rookery.llm.leakage import leaks
from rookery.llm.mapping import map_rows
from rookery.llm.names import pinyin_of
from rookery.llm.packing import pack, token_counts
from rookery.llm.sketches import merge, percentiles, sketch
from rookery.llm.textstats import limit_scores, not_prose, outlier_scores, text_statistics
from rookery.session import cut
from rookery.sources import table


def _reference(spark: SparkSession, sf_dir: str, subdistricts: bool = True) -> DataFrame:
    """The reference lists as one: kind, ref_id, name, parent, district."""
    subs = table(spark, sf_dir, "ref_subdistricts", "subdistrict_id", "name", "district")
    com = table(spark, sf_dir, "ref_communities", "community_id", "name", "subdistrict_id").join(subs.select("subdistrict_id", "district"), "subdistrict_id", "left")
    out = com.select(F.lit("estate").alias("kind"), F.col("community_id").alias("ref_id"), "name", F.col("subdistrict_id").alias("parent"), "district")
    if subdistricts:
        out = out.unionByName(subs.select(F.lit("subdistrict").alias("kind"), F.col("subdistrict_id").alias("ref_id"), "name", F.lit(None).cast("long").alias("parent"), "district"))
    return out


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference entry that each typed community and subdistrict means, -1 if none."""
    pinyin = pinyin_of(table(spark, sf_dir, "ref_communities", "name", "name_pinyin"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("estate", "community_name"), ("subdistrict", "subdistrict"))])).alias("x")
    rows = table(spark, sf_dir, "rental_listings", "listing_id", "community_name", "subdistrict", "district").select(F.col("listing_id").alias("id"), each, "district").select("id", "x.kind", "x.value", "district")
    m = map_rows(rows, _reference(spark, sf_dir), pinyin, ("district",)).where("not exact")
    field = F.when(F.col("kind") == "estate", "community_name").otherwise("subdistrict")
    return m.select(F.col("id").alias("listing_id"), field.alias("field"), "ref_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings whose addresses denote the same building."""
    pinyin = pinyin_of(table(spark, sf_dir, "ref_communities", "name", "name_pinyin"))
    rows = table(spark, sf_dir, "rental_listings", "listing_id", "city", "address_text", "community_name")
    return same_building(rows, "listing_id", "city", "address_text", "community_name", pinyin).select(F.col("a").alias("listing_id_a"), F.col("b").alias("listing_id_b"))


def p3_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The building of each listing, as a class, and how many others stand in it."""
    pinyin = pinyin_of(table(spark, sf_dir, "ref_communities", "name", "name_pinyin"))
    rows = table(spark, sf_dir, "rental_listings", "listing_id", "city", "address_text", "community_name")
    return building_classes(rows, "listing_id", "city", "address_text", "community_name", pinyin).withColumnRenamed("id", "listing_id")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings and partner records of the same home: lid, rid, score, confidence."""
    pinyin = pinyin_of(table(spark, sf_dir, "ref_communities", "name", "name_pinyin"))
    fields = ["city", "district", "community_name", rooms("layout").alias("rooms"), positive("area_sqm").alias("area"), positive("rent_price").alias("rent")]
    one = spark.read.parquet(f"{sf_dir}/rental_listings.parquet").select(F.struct(F.lit("l").alias("side"), F.col("listing_id").alias("key")).alias("id"), *fields)
    two = spark.read.parquet(f"{sf_dir}/partner_listings.parquet").select(F.struct(F.lit("r").alias("side"), F.col("partner_id").alias("key")).alias("id"), *fields)
    both = one.unionByName(two).where("city is not null and community_name is not null").distinct()
    named = map_rows(both.select("id", F.lit("estate").alias("kind"), F.col("community_name").alias("value"), "district"), _reference(spark, sf_dir, False), pinyin, ("district",), entry_candidates)
    named = named.where("ref_id >= 0").select("id", F.col("value").alias("community_name"), "ref_id")
    d = cut(both.join(named, ["id", "community_name"]).select("id.side", "id.key", "city", "ref_id", "rooms", "area", "rent"))
    left = d.where("side = 'l'").drop("side").withColumnRenamed("key", "lid")
    right = d.where("side = 'r'").drop("side").withColumnRenamed("key", "rid")
    return match_records(left, right, ["city", "ref_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a listing and a partner record that describe the same home."""
    return _matches(spark, sf_dir).select(F.col("lid").alias("listing_id"), F.col("rid").alias("partner_id"))


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with score and calibrated confidence."""
    return _matches(spark, sf_dir).select(F.col("lid").alias("listing_id"), F.col("rid").alias("partner_id"), F.round("score", 4).alias("score"), "confidence")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain passages of evaluation items."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text")
    return leaks(docs, "doc_id", "text", items, "item_id", "text").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't natural prose."""
    return not_prose(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang").select(F.col("id").alias("doc_id"))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and outlier scores of every document."""
    stats = cut(text_statistics(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang"))
    return outlier_scores(stats).join(limit_scores(stats), "id").withColumnRenamed("id", "doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document or piece, and the space left in it."""
    return pack(token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per day, as they would be kept."""
    rows = table(spark, sf_dir, "price_area_rows", "distance_bucket", "computed_on", "rent_price", "rent_per_sqm")
    return sketch(rows, ["distance_bucket", "computed_on"], ["rent_price", "rent_per_sqm"])


def _rounded(d: DataFrame) -> DataFrame:
    return d.withColumnRenamed("column", "field").withColumn("value", F.round("value", 4))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per distance bucket over all days, from the sketches of the days."""
    return _rounded(percentiles(merge(_daily(spark, sf_dir), ["distance_bucket"]), ["distance_bucket"]))


def p2_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per week: other spans of the same daily sketches."""
    week = _daily(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "computed_on")))
    return _rounded(percentiles(merge(week, ["distance_bucket", "week"]), ["distance_bucket", "week"]))


QUERIES = {"p2_percentiles": p2_percentiles, "p2_weekly": p2_weekly, "p8_containers": p8_containers, "p10_found": p10_found, "p10_statistics": p10_statistics, "p9_found": p9_found, "p3_found": p3_found, "p3_buildings": p3_buildings, "p4_found": p4_found, "p4_matches": p4_matches, "p6_found": p6_found}
ORACLE: dict[str, str] = {}
