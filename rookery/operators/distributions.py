"""Distances to an origin, grouped order statistics, outlier fences and percentile ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rookery.functions.geo import haversine_m_int
from rookery.functions.text import joined_notes
from rookery.operators.blocks import spread_join
from rookery.operators.ranks import cumulative
from rookery.rules import Rules
from rookery.session import cut


def bucket(c: Column, rules: Rules = Rules()) -> Column:
    """Distance bucket: below the first and second edge, up to and with the third, beyond."""
    a, b, z = rules.edges
    n = rules.bucket_names
    return F.when(c < a, n[0]).when(c < b, n[1]).when(c <= z, n[2]).when(c.isNotNull(), n[3])


def origin_distances(df: DataFrame, lon: float, lat: float, rules: Rules = Rules()) -> DataFrame:
    """Adds ``distance_m`` (whole metres) and ``distance_bucket``."""
    d = df.withColumn("distance_m", haversine_m_int(F.col("longitude"), F.col("latitude"), F.lit(lon), F.lit(lat)))
    return d.withColumn("distance_bucket", bucket(F.col("distance_m"), rules))


def ranked_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct non-null values per key with ``_w`` (rows with it), ``_upto`` (rows of the key up to and with it) and ``_n`` (rows).

    Values are counted before their shuffle and ranked by a range-partitioned sort with partition offsets, so that a key
    with very many values is spread over the cluster. Null keys are a key.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    up = cut(cumulative(c, [*keys, value], "_w"))
    groups = up.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.min(F.col("_upto") - F.col("_w")).alias("_start"))
    return spread_join(up, groups, keys, "inner").withColumn("_upto", F.col("_upto") - F.col("_start")).drop("_start")


def ranked_columns(df: DataFrame, keys: list[str], values: tuple[str, ...]) -> DataFrame:
    """``ranked_values`` of several numeric columns in one sort: ``_col`` names the column, ``_v`` is its value as a double."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("_col"), F.col(v).cast("double").alias("_v")) for v in values])).alias("_x")
    return ranked_values(df.select(*keys, each).select(*keys, "_x._col", "_x._v"), [*keys, "_col"], "_v")


def column_stats(ranked: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``distribution_stats`` of one of the columns of ``ranked_columns``."""
    return rank_stats(ranked.where(F.col("_col") == value), keys, "_v")


def rank_stats(ranked: DataFrame, keys: list[str], value: str, dp: int = 2) -> DataFrame:
    """``distribution_stats`` from ranked values: order statistics at index round_half_even((n - 1) p) per key."""
    hit = lambda i: F.min(F.when(F.col("_upto") > i, F.col(value)))
    at = lambda q: F.bround((F.col("_n") - 1) * q, 0).cast("long")
    middle = (hit(F.floor((F.col("_n") - 1) / 2)) + hit(F.floor(F.col("_n") / 2))) / 2
    s = ranked.groupBy(*keys).agg(F.max("_n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), hit(at(0.25)).alias("p25"), hit(at(0.75)).alias("p75"), middle.alias("median"))
    r = lambda x: F.round(F.col(x).cast("double"), dp)
    # the mean of two decimals may end in a half that isn't exact in binary; it is rounded up as a decimal
    mid = F.coalesce(F.round(F.col("median").try_cast("decimal(28,6)"), dp).cast("double"), r("median"))
    return s.select(*keys, "n", r("min").alias("min"), r("p25").alias("p25"), mid.alias("median"), r("p75").alias("p75"), r("max").alias("max"), F.round((F.col("p75") - F.col("p25")).cast("double"), dp).alias("iqr"))


def distribution_stats(df: DataFrame, keys: list[str], value: str, dp: int = 2) -> DataFrame:
    """Per key: n, min, p25, median, p75, max, iqr. Quartiles are nearest ranks, the median the mean of the middle two.

    Null values don't count; groups without values have no row; null keys are a group.
    """
    return rank_stats(ranked_values(df, keys, value), keys, value, dp)


def _with_ranks(df: DataFrame, ranked: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    share = F.when(F.col("_n") == 1, 0.0).otherwise(F.round((F.col("_upto") - 1) / F.greatest(F.lit(1), F.col("_n") - 1), 4))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return spread_join(df, ranked.where(known).select(*keys, value, share.alias(name)), [*keys, value])


def percentile_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds (rows with a value up to this one - 1) / (n - 1), 4 places, ties share the highest; 0 in a group of one.
    Rows with a null key or value get null.
    """
    return _with_ranks(df, ranked_values(df, keys, value), keys, value, name)


def price_area_rows(df: DataFrame, group: str, community: str, rules: Rules = Rules()) -> DataFrame:
    """Position of ``rent_price`` and ``rent_per_sqm`` within ``group``: medians, ranks, deltas, labels, community medians, notes.

    Fences use the rounded quartiles. Comparisons are inclusive for good and expensive, strict for outliers.
    """
    df = cut(df)  # read once for all its statistics
    columns = (("rent_price", "price"), ("rent_per_sqm", "rps"))
    names = tuple(c for c, _ in columns)
    ranked = cut(ranked_columns(df, [group], names))
    d = df
    for c, short in columns:
        s = column_stats(ranked, [group], c).select(group, *[F.col(x).alias(f"_{short}_{x}") for x in ("median", "p25", "p75", "iqr")])
        d = _with_ranks(d, ranked.where(F.col("_col") == c).drop("_col").withColumnRenamed("_v", c), [group], c, f"{short}_percentile")
        d = spread_join(d, s, [group], "inner")
        v, m, lo, hi, iqr = F.col(c), *[F.col(f"_{short}_{x}") for x in ("median", "p25", "p75", "iqr")]
        d = d.withColumns({
            f"{short}_median": m, f"{short}_delta": F.round(v - m, 2), f"{short}_good": v <= lo, f"{short}_expensive": v >= hi,
            f"{short}_low_outlier": v < lo - 1.5 * iqr, f"{short}_high_outlier": v > hi + 1.5 * iqr,
        }).drop(*[f"_{short}_{x}" for x in ("median", "p25", "p75", "iqr")])
    ranked = cut(ranked_columns(df.where(F.col(community).isNotNull()), [community], names))
    for c, short in columns:
        s = column_stats(ranked, [community], c)
        s = s.select(community, *([F.col("n").alias("community_n")] if short == "price" else []), F.when(F.col("n") >= rules.min_community, F.col("median")).alias(f"community_{short}_median"))
        d = spread_join(d, s, [community])
    d = d.withColumn("community_n", F.coalesce("community_n", F.lit(0)))
    return d.withColumn("notes", joined_notes([
        (F.col("price_good"), "rent_at_or_below_p25"), (F.col("rps_good"), "area_rent_at_or_below_p25"), (F.col("price_expensive"), "rent_at_or_above_p75"), (F.col("rps_expensive"), "area_rent_at_or_above_p75"),
        (F.col("price_low_outlier") | F.col("rps_low_outlier"), "low_outlier"), (F.col("price_high_outlier") | F.col("rps_high_outlier"), "high_outlier"),
        (F.col("apartment_like"), "apartment_like"), (F.col("possible_duplicate"), "possible_duplicate"), (F.col("community_n") >= rules.min_community, "community_compared"),
    ]))
