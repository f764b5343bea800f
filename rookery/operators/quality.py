"""Quality flags, capabilities, tier and notes of listings, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rookery.functions.text import joined_notes, strip
from rookery.rules import Rules

HAS = ("has_price", "has_area", "has_location", "has_region", "has_layout", "has_images", "has_published_at", "has_listing_type", "has_duplicate_risk")
CAPABILITIES = ("can_analyze_price", "can_analyze_area_price", "can_analyze_map", "can_analyze_commute", "can_analyze_region", "can_analyze_freshness", "can_analyze_duplicates")
RISKS = ("area_outlier", "subdistrict_low_confidence", "apartment_like", "possible_duplicate", "missing_published_at", "coordinate_suspicious")


def present(c: str) -> Column:
    """Neither null nor NaN."""
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def rent_per_sqm() -> Column:
    return F.when(F.col("rent_price").isNotNull() & present("area_sqm") & (F.col("area_sqm") > 0), F.round(F.col("rent_price") / F.nullif(F.col("area_sqm"), F.lit(0.0)), 2))


def duplicate_flag(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """Adds ``possible_duplicate``: another row has the same keys; rows with a null or empty key are never duplicates.

    Counts are aggregated before the join back, so that a key shared by very many rows isn't gathered.
    """
    d = df.withColumns({f"_k_{k}": F.nullif(v.cast("string"), F.lit("")) for k, v in keys.items()})
    names = [f"_k_{k}" for k in keys]
    many = d.dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # rows without a key match nothing; a salt keeps them from meeting in one task
    null = F.greatest(*[F.col(n).isNull().cast("int") for n in names]) == 1
    d = d.withColumn("_salt", F.when(null, F.xxhash64(id_col)).otherwise(F.lit(0).cast("long")))
    out = d.join(many.withColumn("_salt", F.lit(0).cast("long")), [*names, "_salt"], "left")
    return out.withColumn("possible_duplicate", F.col("_n").isNotNull()).drop(*names, "_n", "_salt")


def quality_rows(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per listing with flags; null fields give false flags, never null ones.

    Columns that ``df`` lacks (layout, image_urls, listing_type, source_listing_id, address_text) count as null.
    """
    optional = {"layout": "string", "image_urls": "array<string>", "listing_type": "string", "source_listing_id": "string", "address_text": "string"}
    given = df.columns
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in df.columns})
    sure = lambda c: F.coalesce(c, F.lit(False))
    d = duplicate_flag(df, "listing_id", {"title": strip(F.col("title")), "rent": F.col("rent_price"), "community": strip(F.col("community_name"))})
    rps = rent_per_sqm()
    located = present("longitude") & present("latitude")
    inside = sure(F.col("longitude").between(*rules.lon_range) & F.col("latitude").between(*rules.lat_range))
    area = F.when(present("area_sqm"), F.col("area_sqm"))
    outlier = sure(~area.between(rules.min_area, rules.max_area)) | sure(~rps.between(rules.min_rent_per_sqm, rules.max_rent_per_sqm) & area.isNotNull())
    text = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "community_name", "description")])
    sub = strip(F.col("subdistrict"))
    d = d.withColumns({
        "rent_per_sqm": rps, "has_location": located, "coordinate_suspicious": located & ~inside, "area_outlier": outlier,
        "subdistrict_low_confidence": sub.isNull() | sure(F.length(sub) < 3) | sure(sub.rlike(rules.vague_area)),
        "apartment_like": sure(text.rlike(rules.apartment)), "missing_published_at": F.col("published_at").isNull(),
        "can_analyze_price": sure(F.col("rent_price").between(rules.min_rent, rules.max_rent)),
        "can_analyze_region": F.col("district").isNotNull() & sure(F.col("community_name") != ""),
        "can_analyze_freshness": F.col("published_at").isNotNull(), "can_analyze_duplicates": sure((F.col("community_name") != "") & (F.col("source_listing_id") != "")),
        "has_price": F.col("rent_price").isNotNull(), "has_area": area.isNotNull(), "has_region": F.col("district").isNotNull(), "has_layout": F.col("layout").isNotNull(),
        "has_images": sure(F.size("image_urls") > 0), "has_published_at": F.col("published_at").isNotNull(), "has_listing_type": sure(F.col("listing_type") != "unknown"), "has_duplicate_risk": F.col("possible_duplicate"),
        "location_hint": sure(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "address_text", "community_name", "subdistrict", "description")]).rlike(rules.place_hint)),
    })
    d = d.withColumns({
        "can_analyze_area_price": F.col("can_analyze_price") & area.isNotNull() & ~F.col("area_outlier"),
        "can_analyze_map": F.col("has_location") & ~F.col("coordinate_suspicious"),
        "can_analyze_commute": F.col("has_location") & ~F.col("coordinate_suspicious"),
    })
    soft = F.col("area_outlier") | F.col("subdistrict_low_confidence") | F.col("possible_duplicate") | F.col("missing_published_at")
    blocked = ~F.col("can_analyze_price") | ~F.col("can_analyze_map") | F.col("coordinate_suspicious")
    notes = [
        (~F.col("can_analyze_price"), "rent_out_of_range"), (area.isNull(), "area_missing"), (F.col("area_outlier"), "area_outlier"),
        (F.col("coordinate_suspicious") & F.col("location_hint"), "outside_area_but_named"), (F.col("coordinate_suspicious") & ~F.col("location_hint"), "outside_area"),
        (~F.col("has_location"), "no_location"), (F.col("subdistrict_low_confidence"), "vague_subdistrict"),
        (F.col("apartment_like"), "apartment_like"), (F.col("possible_duplicate"), "possible_duplicate"), (F.col("missing_published_at"), "no_publication_date"),
    ]
    d = d.withColumn("tier", F.when(blocked, "blocked").when(soft, "caution").otherwise("ready"))
    return d.withColumn("notes", joined_notes(notes, "core_fields_usable")).drop(*[c for c in optional if c not in given])


def quality_summary(rows: DataFrame) -> DataFrame:
    """One row: total, tiers with zeros, sums of capabilities and risks."""
    tiers = [F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in ("ready", "caution", "blocked")]
    return rows.agg(F.count(F.lit(1)).alias("total"), *tiers, *[F.count_if(c).alias(c) for c in (*CAPABILITIES, *RISKS)])
