"""Comparison with neighbours within a radius and with the same community."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rookery.functions.geo import haversine_m_int
from rookery.functions.text import joined_notes
from rookery.operators.blocks import spread_join
from rookery.operators.distributions import column_stats, ranked_columns
from rookery.operators.near import near_pairs
from rookery.operators.ranks import global_order
from rookery.rules import Rules
from rookery.session import cut


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select("b", "a"))


def neighbour_stats(df: DataFrame, id_col: str, values: tuple[str, ...], radius_m: float) -> DataFrame:
    """Per id the stats of its neighbours' ``values`` (itself excluded); ids without neighbours have no row.

    A point's neighbours are counted by value before they are brought together, and their ranks are found by sorting all
    neighbourhoods by range, so that a crowded point fits into no single task.
    """
    p = both_ways(near_pairs(df, id_col, "longitude", "latitude", radius_m))
    known = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("b")).agg(*[F.min(v).alias(v) for v in values])
    ranked = cut(ranked_columns(spread_join(p, known, ["b"], "inner"), ["a"], values))
    out = None
    for v in values:
        s = column_stats(ranked, ["a"], v).select(F.col("a").alias(id_col), F.col("n").alias(f"{v}_n"), F.col("median").alias(f"{v}_median"), F.col("p75").alias(f"{v}_p75"))
        out = s if out is None else out.join(s, id_col, "full")
    return out


def location_value(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``df`` has listing_id, longitude, latitude, community_name, rent_price, rent_per_sqm. Counts are given below the
    least sample too; medians and labels are not.
    """
    sure = lambda c: F.coalesce(c, F.lit(False))
    near = neighbour_stats(df, "listing_id", ("rent_price", "rent_per_sqm"), rules.nearby_m)
    d = df.join(near, "listing_id", "left").withColumn("nearby_n", F.coalesce("rent_price_n", F.lit(0)))
    enough = F.col("nearby_n") >= rules.min_nearby
    d = d.withColumns({"nearby_price_median": F.when(enough, F.col("rent_price_median")), "nearby_rps_median": F.when(enough, F.col("rent_per_sqm_median")), "_p75": F.when(enough, F.col("rent_per_sqm_p75"))})
    d = d.withColumns({
        "price_delta_from_nearby": F.round(F.col("rent_price") - F.col("nearby_price_median"), 2),
        "below_nearby_median": sure(F.col("rent_price") < F.col("nearby_price_median")), "nearby_good_value": sure(F.col("rent_per_sqm") < F.col("nearby_rps_median")),
        "nearby_expensive": sure(F.col("rent_per_sqm") >= F.col("_p75")),
    })
    ranked = cut(ranked_columns(df.where(F.col("community_name").isNotNull()), ["community_name"], ("rent_price", "rent_per_sqm")))
    com = column_stats(ranked, ["community_name"], "rent_price").select("community_name", F.col("n").alias("community_n"), F.col("median").alias("_cm"), F.col("min").alias("_cmin"))
    rps = column_stats(ranked, ["community_name"], "rent_per_sqm").select("community_name", F.col("min").alias("_crmin"))
    d = spread_join(spread_join(d, com, ["community_name"]), rps, ["community_name"]).withColumn("community_n", F.coalesce("community_n", F.lit(0)))
    many = F.col("community_n") >= rules.min_community
    best = lambda a, b: sure(many & (F.col(a) == F.col(b)))
    return d.withColumns({
        "community_price_median": F.when(many, F.col("_cm")), "below_community_median": sure(many & (F.col("rent_price") < F.col("_cm"))), "above_community_median": sure(many & (F.col("rent_price") > F.col("_cm"))),
        "best_price_in_community": best("rent_price", "_cmin"), "best_area_price_in_community": best("rent_per_sqm", "_crmin"),
    }).withColumn("notes", _value_notes(rules, df.columns)).drop("_cm", "_cmin", "_crmin", "_p75", "rent_price_n", "rent_price_median", "rent_price_p75", "rent_per_sqm_n", "rent_per_sqm_median", "rent_per_sqm_p75")


def _value_notes(rules: Rules, columns: list[str]) -> Column:
    enough, many = F.col("nearby_n") >= rules.min_nearby, F.col("community_n") >= rules.min_community
    return joined_notes([
        (~enough, "few_neighbours"), (enough & F.col("below_nearby_median"), "rent_below_neighbours"), (enough & F.col("nearby_good_value"), "area_rent_below_neighbours"), (enough & F.col("nearby_expensive"), "area_rent_at_or_above_neighbours_p75"),
        (many & F.col("below_community_median"), "rent_below_community"), (many & F.col("best_price_in_community"), "least_rent_in_community"), (many & F.col("best_area_price_in_community"), "least_area_rent_in_community"),
        *[(F.col(c), c) for c in ("apartment_like", "possible_duplicate") if c in columns],
    ])


def _mean_degrees(c: str) -> Column:
    """Mean of a coordinate, 6 places, halves up: from sums of whole nanodegrees, so that it doesn't depend on their order."""
    total, n = 2 * F.sum(F.round(F.col(c) * 1e9).cast("decimal(38,0)")), F.count(F.lit(1)).cast("decimal(20,0)") * 2000
    shifted = total + n / 2
    return ((shifted - F.pmod(shifted, n)) / n).cast("double") / 1e6


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id``, ``root``: the least id of each node's connected component (undirected ``a``, ``b``).

    Min-label rounds with pointer jumping over DataFrames; every round is cut by a checkpoint, and the number of rounds
    grows with the logarithm of a component's diameter.
    """
    e = cut(both_ways(edges.select("a", "b")))
    lab = cut(nodes.select("id", F.col("id").alias("root")))
    while True:
        near = e.join(lab.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        hop = lab.join(near, "id", "left").select("id", "root", F.least("root", F.coalesce("m", "root")).alias("new"))
        # the old root follows the least label any of its members saw
        push = hop.groupBy("root").agg(F.min("new").alias("to"))
        hop = hop.join(push, "root").select("id", "root", F.least("new", "to").alias("new"))
        jump = hop.select(F.col("id").alias("new"), F.col("new").alias("far"))
        nxt = cut(hop.join(jump, "new", "left").select("id", F.coalesce("far", "new").alias("to"), "root"))
        lab = nxt.select("id", F.col("to").alias("root"))
        if nxt.where("to <> root").limit(1).count() == 0:
            return lab


def density_clusters(df: DataFrame, id_col: str, rules: Rules = Rules()) -> DataFrame:
    """DBSCAN with names that don't depend on order: clusters are numbered by their least core id (as text), a border
    point joins the lowest-numbered cluster next to it, noise has size 0 and no centroid. ``centroid_m`` is the distance to the
    rounded centroid in whole metres.
    """
    if rules.eps_m <= 0 or rules.min_samples <= 0:
        raise ValueError("eps_m and min_samples must be positive")
    pts = df.select(F.col(id_col).cast("string").alias("id"), "longitude", "latitude")
    pairs = cut(both_ways(near_pairs(pts, "id", "longitude", "latitude", rules.eps_m)))
    deg = pts.join(pairs.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("neighbours")), "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))
    deg = cut(deg.withColumn("is_core", F.col("neighbours") + 1 >= rules.min_samples))
    core = deg.where("is_core").select("id")
    ce = pairs.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi").where("a < b")
    roots = cut(components(ce, core))
    names = global_order(roots.select("root").distinct(), [F.col("root")]).select("root", (F.col("_pos") + 1).alias("no"))
    of_core = cut(roots.join(names, "root").select("id", "no"))
    border = pairs.join(of_core.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("no").alias("bno"))
    d = deg.join(of_core, "id", "left").join(border, "id", "left").withColumn("no", F.when(F.col("is_core"), F.col("no")).otherwise(F.col("bno"))).drop("bno")
    size = d.where("no is not null").groupBy("no").agg(F.count(F.lit(1)).alias("size"), _mean_degrees("longitude").alias("centroid_lon"), _mean_degrees("latitude").alias("centroid_lat"))
    d = spread_join(d, size, ["no"])
    noise = F.col("no").isNull()
    notes = joined_notes([
        (noise, "outside_all_clusters"), (~noise & F.col("is_core"), "core_point"), (~noise & ~F.col("is_core"), "border_point"),
        (F.col("size") >= rules.dense_cluster, "dense_cluster"), (F.col("size") < min(rules.dense_cluster, 2 * rules.min_samples), "small_cluster"),
    ])
    return d.select(
        F.col("id").alias(id_col), F.when(F.col("no").isNull(), "noise").otherwise(F.format_string("c%05d", F.col("no"))).alias("cluster"), F.coalesce("size", F.lit(0)).alias("cluster_size"),
        "is_core", F.col("neighbours").alias("neighbour_count"), "centroid_lon", "centroid_lat",
        haversine_m_int("longitude", "latitude", "centroid_lon", "centroid_lat").alias("centroid_m"), notes.alias("notes"),
    )
