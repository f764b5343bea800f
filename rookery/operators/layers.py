"""Layers merged by id, faceted filters, scores, levels, ranking and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rookery.functions.text import non_empty
from rookery.rules import Rules


def merge_layers(base: DataFrame, layers: list[tuple[DataFrame, list[str]]], key: str, fill: dict[str, str] | None = None) -> DataFrame:
    """Left joins by ``key``; of each layer only the named columns that it has and the result lacks. ``fill`` names columns that
    the result may lack in the end and the layer columns to take them from.
    """
    out = base
    for df, columns in layers:
        take = [c for c in columns if c in df.columns and c != key and c not in out.columns]
        out = out.join(df.select(key, *take), key, "left")
    return out.withColumns({c: F.col(f) for c, f in (fill or {}).items() if c not in out.columns and f in out.columns})


def facet_filter(df: DataFrame, ranges: dict[str, tuple[float, float]], members: dict[str, list[str]] | None = None, strict: dict[str, list[str]] | None = None, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive ranges (null removes the row; reversed bounds are swapped), memberships, flags. An empty list in
    ``members`` means no filter, in ``strict`` it matches nothing. Columns that don't exist aren't filtered on.
    """
    for c, (a, b) in ranges.items():
        if c in df.columns:
            df = df.where(F.col(c).between(min(a, b), max(a, b)))
    for c, vs in (members or {}).items():
        if vs and c in df.columns:
            df = df.where(F.col(c).isin(vs))
    for c, vs in (strict or {}).items():
        if c in df.columns:
            df = df.where(F.col(c).isin(vs) if vs else F.lit(False))
    for c in without:
        if c in df.columns:
            df = df.where(~F.coalesce(F.col(c), F.lit(False)))
    for c in only:
        if c in df.columns:
            df = df.where(F.coalesce(F.col(c), F.lit(False)))
    return df


def weighted_scores(df: DataFrame, good: dict[str, float], bad: dict[str, float]) -> DataFrame:
    """Adds ``value_score`` (0–100, 1 place) from min-max scaled columns: high values of ``good`` and low ones of ``bad`` count.

    Equal or absent values and nulls scale to 0.5; weights that sum to nothing count alike. The bounds are one row.
    """
    weights = {**good, **bad}
    if sum(weights.values()) <= 0:
        weights = dict.fromkeys(weights, 1.0)
    total = sum(weights.values())
    bounds = df.agg(*[f(c).cast("double").alias(f"_{n}_{c}") for c in weights for n, f in (("min", F.min), ("max", F.max))])
    d = df.crossJoin(F.broadcast(bounds))  # one row
    parts = []
    for c, w in weights.items():
        lo, hi = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        x = F.try_divide(F.col(c) - lo, F.nullif(hi - lo, F.lit(0.0)))
        parts.append(F.coalesce(x if c in good else 1 - x, F.lit(0.5)) * (w / total))
    return d.withColumn("value_score", F.round(sum(parts[1:], parts[0]) * 100, 1)).drop(*[f"_{n}_{c}" for c in weights for n in ("min", "max")])


def score_levels(df: DataFrame, score: str = "value_score", low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Adds ``value_level`` (high, low, neutral) by linearly interpolated quantiles; equal thresholds give neutral."""
    q = df.agg(F.round(F.percentile(score, low), 9).alias("_lo"), F.round(F.percentile(score, high), 9).alias("_hi"))
    level = F.when(F.col("_lo") == F.col("_hi"), "neutral").when(F.col(score) >= F.col("_hi"), "high").when(F.col(score) <= F.col("_lo"), "low").otherwise("neutral")
    return df.crossJoin(F.broadcast(q)).withColumn("value_level", level).drop("_lo", "_hi")


def ranking(df: DataFrame, down: list[str], up: list[str], last: str) -> list[Column]:
    """Sort expressions: ``down`` falling, ``up`` rising, nulls last, then ``last``; only columns that exist."""
    return [F.col(c).desc_nulls_last() for c in down if c in df.columns] + [F.col(c).asc_nulls_last() for c in up if c in df.columns] + [F.col(last)]


def reasons(cases: list[tuple[Column, str]], default: str) -> Column:
    """Array of the names whose condition holds, in order; the default alone if none does."""
    got = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in cases]), lambda x: x.isNotNull())
    return F.when(F.size(got) == 0, F.array(F.lit(default))).otherwise(got)


def most_frequent(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key the most frequent non-empty value of the first column that has any; ties go to the least value."""
    out = df.select(*keys).distinct()
    for i, c in enumerate(columns):
        n = df.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(n.groupBy(*keys).agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias(f"_v{i}")), keys, "left")
    return out.select(*keys, non_empty(*[F.col(f"_v{i}") for i in range(len(columns))]).alias("name"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Batches put together by column name; a column that a batch lacks is null in it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dictionary(df: DataFrame, prefix: str, name: str) -> DataFrame:
    """Each pair of prefix and name once; blank ones don't count. Used in the order of the prefixes' lengths, the longest first."""
    return df.where((F.coalesce(F.col(prefix), F.lit("")) != "") & (F.coalesce(F.col(name), F.lit("")) != "")).select(prefix, name).distinct()


def card_enrichment(cards: DataFrame, history: DataFrame, tie: list[Column], now: Column, zone: str = "Asia/Shanghai") -> DataFrame:
    """Cards with ``rent_price`` as last observed (else their own), the days since the host was seen as a class and the day itself,
    and the latest change of the rent as text and class.

    ``cards`` has listing_id, source_listing_id, rent_price, host_last_login_at; ``history`` comes from ``price_history``. Ids are
    those of the source, whichever source it is. Cards whose id isn't observed keep what they have.
    """
    order = F.struct("observed_at", *[t.alias(f"_t{i}") for i, t in enumerate(tie)])
    moved = F.when(F.coalesce(F.col("delta") != 0, F.lit(False)), order)
    h = history.where(F.col("source_listing_id").isNotNull()).groupBy("source_listing_id").agg(
        F.max_by("rent_price", F.when(F.col("rent_price").isNotNull(), F.struct("observed_at", "source", *[t.alias(f"_t{i}") for i, t in enumerate(tie)]))).alias("_rent"),
        F.max_by(F.struct("delta", "previous_price", "rent_price"), F.when(moved.isNotNull(), F.struct("observed_at", "source", *[t.alias(f"_t{i}") for i, t in enumerate(tie)]))).alias("_m"),
    )
    d = cards.join(h, "source_listing_id", "left")
    seen = F.from_utc_timestamp("host_last_login_at", zone)
    days = F.datediff(F.to_date(F.from_utc_timestamp(now, zone)), F.to_date(seen))
    change = F.concat(F.when(F.col("_m.delta") > 0, "↑+").otherwise("↓"), F.col("_m.delta").cast("string"), F.lit("  "), F.col("_m.previous_price").cast("string"), F.lit("→"), F.col("_m.rent_price").cast("string"))
    return d.withColumns({
        "rent_price": F.coalesce("_rent", "rent_price"), "login_text": F.coalesce(F.date_format(seen, "yyyy-MM-dd"), F.lit("unknown")),
        "login_class": F.when(days < 30, "fresh").when(days < 90, "warn").when(days.isNotNull(), "stale").otherwise("unknown"),
        "price_text": F.coalesce(change, F.lit("first record")), "price_class": F.when(F.col("_m.delta") > 0, "up").when(F.col("_m.delta") < 0, "down").otherwise("none"),
    }).drop("_rent", "_m")


def rings(spark: SparkSession, lon: float, lat: float, rules: Rules = Rules(), opacities: tuple[float, ...] = (0.9, 0.75, 0.6, 0.45)) -> DataFrame:
    """One row for each distance bucket: the ring at its outer edge (none for the last) around the origin, and its points' opacity."""
    edges = [*[float(e) for e in rules.edges], None]
    return spark.createDataFrame([(n, e, lon, lat, o) for n, e, o in zip(rules.bucket_names, edges, opacities)], "distance_bucket string, radius_m double, longitude double, latitude double, opacity double")
