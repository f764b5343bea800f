"""Queries of the listing operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rookery.functions.geo import haversine_m
from rookery.functions.text import all_ints, clean_text, dashed, epoch_time, first_int, head_and_rest, iso_time, layout_parts, price_bounds, trailing_id
from rookery.operators import distributions as dist, history as hist, layers, location as loc, quality as qual, store
from rookery.operators.near import near_pairs
from rookery.plans.listings_sql import ORACLE
from rookery.rules import Rules
from rookery.session import cut
from rookery.sources import pages, table

R = Rules()
ORIGIN = (112.42, 30.65)
NOW = "2026-06-01 00:00:00"
#: Wider radii for neighbours and neighbourhoods.
WIDE_M, WIDE_EPS_M = 1000.0, 800.0


def _tie():
    return [F.coalesce(F.col("crawl_run_id"), F.lit(1 << 30)).alias("t1"), F.coalesce(F.col("rent_price"), F.lit(-1)).alias("t2"), F.coalesce(F.col("availability_status"), F.lit("")).alias("t3")]


def _listings(spark: SparkSession, d: str) -> DataFrame:
    """Listings, repeated deliveries once; ids as text, NaN as null."""
    num = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return table(spark, d, "rental_listings").select(
        F.col("listing_id").cast("string").alias("listing_id"), "source", "source_listing_id", "title", "description", "rent_price", num("area_sqm"), "layout", "district", "subdistrict",
        "community_name", num("longitude"), num("latitude"), "published_at", "host_last_login_at", "first_seen_at", "city", "image_urls", "listing_type", "address_text",
    ).distinct()


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return qual.quality_rows(_listings(spark, d), R)


QUALITY_COLS = ["listing_id", "rent_per_sqm", *qual.HAS, *qual.CAPABILITIES, *qual.RISKS, "location_hint", "tier", "notes"]


def _distances(spark, d, q=None, origin=ORIGIN):
    q = _quality(spark, d) if q is None else q
    return dist.origin_distances(q.where("can_analyze_map"), *origin, R)


def _candidates(spark, d, q=None, origin=ORIGIN):
    q = _distances(spark, d, q, origin).where("tier <> 'blocked' and can_analyze_price and can_analyze_area_price")
    return q.select("listing_id", "community_name", "longitude", "latitude", "distance_bucket", "rent_price", "rent_per_sqm", "apartment_like", "possible_duplicate")


def listing_scan_by_source(spark, d):
    return _listings(spark, d).where("source = 'ugc_c'").select("listing_id", "title", "rent_price", "district")


def quality_rows(spark, d):
    return _quality(spark, d).select(*QUALITY_COLS)


def quality_summary(spark, d):
    return qual.quality_summary(_quality(spark, d))


def duplicate_groups(spark, d):
    """Groups of listings with one layout, rent and community: the flag with keys that occur more than once."""
    x = qual.duplicate_flag(_listings(spark, d), "listing_id", {"layout": qual.strip(F.col("layout")), "rent": F.col("rent_price"), "community": qual.strip(F.col("community_name"))}).where("possible_duplicate")
    return x.groupBy(qual.strip(F.col("layout")).alias("layout"), "rent_price", qual.strip(F.col("community_name")).alias("community")).agg(F.count(F.lit(1)).alias("n"))


def distance_rows(spark, d):
    return _distances(spark, d).select("listing_id", "distance_m", "distance_bucket")


def distance_bucket_summary(spark, d):
    return _distances(spark, d).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("distance_bucket") == b).alias(b) for b in R.bucket_names])


def bucket_distribution_stats(spark, d):
    return dist.distribution_stats(_candidates(spark, d), ["distance_bucket"], "rent_price")


def community_distribution_stats(spark, d):
    return dist.distribution_stats(_candidates(spark, d).where("community_name is not null"), ["community_name"], "rent_per_sqm").where(F.col("n") >= R.min_community)


def price_percentile_rank(spark, d):
    return dist.percentile_ranks(_candidates(spark, d), ["distance_bucket"], "rent_price", "percentile").select("listing_id", "distance_bucket", "percentile")


PA = ["listing_id", "distance_bucket", *[f"{s}_{x}" for s in ("price", "rps") for x in ("median", "percentile", "delta", "good", "expensive", "low_outlier", "high_outlier")], "community_n", "community_price_median", "community_rps_median", "notes"]


def price_area_rows(spark, d):
    return dist.price_area_rows(_candidates(spark, d), "distance_bucket", "community_name", R).select(*PA)


def price_area_summary(spark, d):
    p = dist.price_area_rows(_candidates(spark, d), "distance_bucket", "community_name", R)
    labels = [f"{s}_{x}" for s in ("price", "rps") for x in ("good", "expensive", "low_outlier", "high_outlier")]
    return p.groupBy("distance_bucket").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in (*labels, "apartment_like", "possible_duplicate")])


def nearby_pairs(spark, d):
    c = _candidates(spark, d)
    return near_pairs(c, "listing_id", "longitude", "latitude", R.nearby_m)


def nearby_stats(spark, d, metres=R.nearby_m):
    s = loc.neighbour_stats(cut(_candidates(spark, d)), "listing_id", ("rent_price",), metres)
    return s.select("listing_id", F.col("rent_price_n").alias("n"), F.col("rent_price_median").alias("median"), F.col("rent_price_p75").alias("p75"))


def nearby_stats_wide(spark, d):
    """The same within a kilometre."""
    return nearby_stats(spark, d, WIDE_M)


LV = ["listing_id", "nearby_n", "nearby_price_median", "nearby_rps_median", "price_delta_from_nearby", "below_nearby_median", "nearby_good_value", "nearby_expensive", "community_n", "community_price_median", "below_community_median", "above_community_median", "best_price_in_community", "best_area_price_in_community", "notes"]


def location_value_rows(spark, d):
    return loc.location_value(cut(_candidates(spark, d)), R).select(*LV)


def location_value_summary(spark, d):
    flags = [c for c in LV if c.startswith(("below", "above", "best")) or c in ("nearby_good_value", "nearby_expensive")]
    v = loc.location_value(cut(_candidates(spark, d)), R)
    return v.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(c) for c in flags], F.count_if(F.col("nearby_n") >= R.min_nearby).alias("with_nearby"), F.count_if(F.col("community_n") >= R.min_community).alias("with_community"))


def community_best(spark, d):
    return loc.location_value(cut(_candidates(spark, d)), R).where("best_price_in_community").select("listing_id", "community_n")


def eps_neighborhood(spark, d, metres=R.eps_m):
    q = cut(_quality(spark, d).where("can_analyze_map").select("listing_id", "longitude", "latitude"))
    p = loc.both_ways(near_pairs(q, "listing_id", "longitude", "latitude", metres))
    n = p.groupBy(F.col("a").alias("listing_id")).agg(F.count(F.lit(1)).alias("n"))
    return q.select("listing_id").join(n, "listing_id", "left").select("listing_id", (F.coalesce("n", F.lit(0)) + 1).alias("n_with_self"))


def eps_neighborhood_wide(spark, d):
    """The same within 800 m."""
    return eps_neighborhood(spark, d, WIDE_EPS_M)


def _clusters(spark, d, q=None):
    q = _quality(spark, d) if q is None else q
    return loc.density_clusters(cut(q.where("can_analyze_map").select("listing_id", "longitude", "latitude")), "listing_id", R)


def geo_cluster_rows(spark, d):
    return _clusters(spark, d)


def geo_cluster_summary(spark, d):
    c = cut(_clusters(spark, d))
    sizes = c.where("cluster <> 'noise'").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    s = sizes.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest"), F.coalesce(F.median("n"), F.lit(0.0)).alias("median_size"))
    return c.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("cluster") == "noise").alias("noise"), F.count_if("is_core").alias("core")).crossJoin(s)  # one row each


def top_clusters(spark, d):
    c = _clusters(spark, d).where("cluster <> 'noise'").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "cluster").limit(10)


def cluster_area_label(spark, d):
    c = _clusters(spark, d).where("cluster <> 'noise'").select("listing_id", "cluster")
    return layers.most_frequent(c.join(_listings(spark, d), "listing_id"), ["cluster"], ["community_name", "subdistrict", "district"])


def _observations(spark, d):
    return table(spark, d, "listing_observations", "source", "source_listing_id", "observed_at", "crawl_run_id", "rent_price", "availability_status", "days_on_market").distinct()


def _history(spark, d):
    o = _observations(spark, d).withColumn("_dom", F.coalesce("days_on_market", F.lit(-1)))
    return hist.price_history(o, hist.KEYS, "observed_at", "rent_price", [*_tie(), F.col("_dom")])


HIST = ["previous_price", "first_price", "lowest_price", "delta", "delta_share", "delta_from_first", "delta_from_lowest", "direction"]


def price_history(spark, d):
    return _history(spark, d).select(*hist.KEYS, F.unix_micros("observed_at").alias("observed_us"), "rent_price", *HIST)


def price_history_summary(spark, d):
    h = _history(spark, d)
    last = hist.latest(_observations(spark, d), hist.KEYS, "observed_at", _tie(), ["availability_status"])
    s = h.agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("delta") != 0).alias("changes"), F.count_if(F.col("delta") < 0).alias("drops"), F.count_if(F.col("delta") > 0).alias("rises"))
    inactive = last.agg(F.count(F.lit(1)).alias("listings"), F.count_if(F.col("availability_status") != "active").alias("inactive_latest"))
    return s.crossJoin(inactive)  # one row each


def latest_status(spark, d):
    x = hist.latest(_observations(spark, d), hist.KEYS, "observed_at", _tie(), ["availability_status", "rent_price"])
    return x.select(*hist.KEYS, F.unix_micros("observed_at").alias("observed_us"), "availability_status", "rent_price")


def latest_change(spark, d):
    x = hist.latest_change(_history(spark, d), hist.KEYS, "observed_at", [*_tie(), F.col("_dom")], "rent_price")
    return x.select(*hist.KEYS, F.unix_micros("changed_at").alias("changed_us"), "latest_delta", "latest_price")


def _moves(spark, d, sign):
    h = _history(spark, d).where(f"delta {sign} 0")
    key = F.col("delta_share").asc() if sign == "<" else F.col("delta_share").desc()
    return h.orderBy(key, *hist.KEYS, "observed_at").select(*hist.KEYS, F.unix_micros("observed_at").alias("observed_us"), "delta", "delta_share")


def price_drops(spark, d):
    return _moves(spark, d, "<")


def price_rises(spark, d):
    return _moves(spark, d, ">")


def _state(spark, d):
    return hist.latest(_observations(spark, d), hist.KEYS, "observed_at", _tie(), ["availability_status"]).withColumnRenamed("availability_status", "status")


def reconcile_partial(spark, d):
    """Listings in scope that the last snapshot lacks; it doesn't claim to be full."""
    scope = _listings(spark, d).where(F.col("rent_price").between(R.min_rent, R.max_rent) & F.col("district").isNotNull()).select(*hist.KEYS)
    seen = _dated(table(spark, d, "listing_snapshots", "snapshot_date", *hist.KEYS), F.max).where("snapshot_date = _date").select(*hist.KEYS)
    return hist.reconcile(scope, seen, _state(spark, d), hist.KEYS, None)[0]


def reconcile_full(spark, d):
    """The last snapshot but one against a crawl that saw everything else: counts of a full reconciliation."""
    snap = table(spark, d, "listing_snapshots", "snapshot_date", *hist.KEYS)
    scope = snap.where("snapshot_date = date '2026-05-16'").select(*hist.KEYS)
    seen = snap.where("snapshot_date <> date '2026-05-16'").select(*hist.KEYS)
    return hist.reconcile(scope, seen, _state(spark, d), hist.KEYS, scope.distinct().count())[1]


def _layers(spark, d, clusters=False):
    """Quality, distances, prices, neighbours and clusters as one table; the shared parts are built once."""
    whole = cut(_quality(spark, d))
    q = whole.select("listing_id", "rent_price", "area_sqm", "rent_per_sqm", "tier", "apartment_like", "possible_duplicate", "notes")
    dd = _distances(spark, d, whole).select("listing_id", "distance_m", "distance_bucket", F.col("longitude").alias("listing_longitude"), F.col("latitude").alias("listing_latitude"))
    c = cut(_candidates(spark, d, whole))
    pa = dist.price_area_rows(c, "distance_bucket", "community_name", R).select("listing_id", "rent_per_sqm", "price_good", "rps_good", "price_expensive")
    lv = loc.location_value(c, R).select("listing_id", "nearby_n", "below_nearby_median", "nearby_good_value")
    parts = [(dd, ["distance_m", "distance_bucket", "listing_longitude", "listing_latitude"]), (pa, ["rent_per_sqm", "price_good", "rps_good", "price_expensive"]), (lv, ["nearby_n", "below_nearby_median", "nearby_good_value"])]
    if clusters:
        parts.append((_clusters(spark, d, whole), ["cluster", "cluster_size", "is_core", "neighbour_count", "centroid_lon", "centroid_lat"]))
    return layers.merge_layers(q, parts, "listing_id", {"longitude": "listing_longitude", "latitude": "listing_latitude"})


def merged_layers(spark, d):
    return _layers(spark, d, True).drop("listing_longitude", "listing_latitude")


def _filtered(spark, d):
    return layers.facet_filter(_layers(spark, d), {"rent_price": (9000, 1500), "area_sqm": (15, 150)}, {"distance_bucket": ["near", "middle"]}, {"tier": ["ready", "caution"]}, ("possible_duplicate",))


def faceted_filter(spark, d):
    return _filtered(spark, d).select("listing_id", "rent_price", "distance_bucket", "tier")


def _scored(spark, d):
    return layers.score_levels(layers.weighted_scores(cut(_filtered(spark, d)), {"area_sqm": 45.0}, {"distance_m": 35.0, "rent_price": 20.0}))


def value_score(spark, d):
    return _scored(spark, d).select("listing_id", "value_score")


def value_level(spark, d):
    return _scored(spark, d).groupBy("value_level").agg(F.count(F.lit(1)).alias("n"))


def ranked_candidates(spark, d):
    s = _scored(spark, d)
    return s.orderBy(*layers.ranking(s, ["value_score", "nearby_good_value", "price_good"], ["distance_m"], "listing_id")).limit(20).select("listing_id", "value_score", "distance_m")


def candidate_reasons(spark, d):
    s = _scored(spark, d)
    good = layers.reasons([(F.col("tier") == "ready", "tier_ready"), (F.col("value_level") == "high", "high_score"), (F.col("price_good"), "low_price"), (F.col("rps_good"), "low_area_price"), (F.col("nearby_good_value"), "below_nearby_area_price"), (F.col("below_nearby_median"), "below_nearby_price")], "neutral")
    risk = layers.reasons([(F.col("tier") == "caution", "tier_caution"), (F.col("apartment_like"), "apartment_like"), (F.col("nearby_n") < R.min_nearby, "few_neighbours")], "none_known")
    return s.select("listing_id", F.concat_ws("; ", good).alias("reasons"), F.concat_ws("; ", risk).alias("risks"))


def _accepted(spark, d):
    li = _listings(spark, d)
    text = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "description", "district", "subdistrict", "community_name")])
    why = F.filter(F.array(F.when(F.col("rent_price").isNull(), "no_rent"), F.when(F.col("rent_price") < 1500, "rent_low"), F.when(F.col("rent_price") > 6000, "rent_high"), F.when(text.contains("短租"), "short_let"), F.when(text.rlike(R.apartment), "apartment")), lambda x: x.isNotNull())
    return li.withColumn("why", why)


def acceptance_filter(spark, d):
    return _accepted(spark, d).select("listing_id", (F.size("why") == 0).alias("accepted"), F.concat_ws("; ", "why").alias("reasons"))


def filter_reason_counts(spark, d):
    return _accepted(spark, d).select(F.explode("why").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def staleness(spark, d):
    now = F.lit(NOW).cast("timestamp")
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp("host_last_login_at")) / 86400).cast("int")
    local = F.datediff(F.to_date(F.from_utc_timestamp(now, "Asia/Shanghai")), F.to_date(F.from_utc_timestamp("host_last_login_at", "Asia/Shanghai")))
    return _listings(spark, d).select("listing_id", days.alias("days"), local.alias("local_days"), F.when(days < 30, "fresh").when(days < 90, "aging").when(days.isNotNull(), "stale").alias("class"))


def text_numbers(spark, d):
    t = _listings(spark, d).where("description is not null")
    return t.select("listing_id", first_int(F.col("description")).alias("first_int"), price_bounds(F.col("description"))["low"].alias("low"), price_bounds(F.col("description"))["high"].alias("high"), F.size(all_ints(F.col("description"))).alias("n"))


def text_layout(spark, d):
    p = layout_parts(F.translate("layout", "０１２３４５６７８９", "0123456789"))
    return _listings(spark, d).select("listing_id", p["rooms"].alias("rooms"), p["halls"].alias("halls"), p["baths"].alias("baths"))


def text_split(spark, d):
    h = head_and_rest(F.col("title"))
    return _listings(spark, d).select("listing_id", h["head"].alias("head"), h["rest"].alias("rest"), dashed(F.col("community_name"), 0).alias("part"))


def clean_texts(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.sha2(clean_text(F.col("text"), entities=False), 256).alias("clean_hash"), F.length(clean_text(F.col("text"), entities=False)).alias("n"))


def url_parts(spark, d):
    u = table(spark, d, "rental_listings", "listing_id", "source_url").distinct()
    return u.select("listing_id", F.try_parse_url("source_url", F.lit("HOST")).alias("host"), trailing_id(F.col("source_url")).alias("trailing_id"))


def props_json_parse(spark, d):
    e = table(spark, d, "events", "event_id", "props")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def prefix_lookup(spark, d):
    subs = table(spark, d, "ref_subdistricts", "name").select(F.substring("name", 1, 2).alias("prefix"), F.col("name").alias("mapped"))
    subs = subs.unionByName(table(spark, d, "ref_subdistricts", "name").select(F.col("name").alias("prefix"), F.col("name").alias("mapped")))
    return store.longest_prefix(table(spark, d, "rental_listings", "subdistrict"), "subdistrict", subs, "prefix", "mapped")


def _snaps(spark, d):
    """All snapshots; ``seq`` puts their dates first, so that one pass by it equals merging them date by date."""
    s = table(spark, d, "listing_snapshots", "snapshot_date", *hist.KEYS, "title", "rent_price", "last_seen_at", "delivered_at")
    seq = F.struct("snapshot_date", F.unix_micros("last_seen_at"), F.unix_micros("delivered_at"), F.coalesce("rent_price", F.lit(-1)), F.coalesce("title", F.lit("")))
    return s.select("snapshot_date", *hist.KEYS, "title", "rent_price", F.unix_micros("last_seen_at").alias("first_us"), seq.alias("seq"))


def _dated(snaps, bound):
    """Snapshot rows with ``_date``, the first (F.min) or last (F.max) snapshot_date of the table."""
    return snaps.crossJoin(F.broadcast(snaps.agg(bound("snapshot_date").alias("_date"))))  # one row


def upsert_merge(spark, d):
    s = _snaps(spark, d)
    return store.upsert(s.select(*hist.KEYS, "title", "rent_price", "first_us").limit(0), s, hist.KEYS, "seq", "first_us")


def insert_or_ignore(spark, d):
    """What the snapshots after the first add to a store that holds the first."""
    s = _dated(_snaps(spark, d), F.min)
    one = s.where("snapshot_date = _date").select(*hist.KEYS, "title", "rent_price").distinct()
    return store.insert_or_ignore(one, s.where("snapshot_date > _date"), hist.KEYS, "seq")


def first_gap(spark, d):
    return store.first_gap(table(spark, d, "listing_observations", "crawl_run_id").where("crawl_run_id is not null"), "crawl_run_id")


def union_marker(spark, d):
    m = spark.range(1).select(F.lit("origin").alias("listing_id"), F.lit(ORIGIN[0]).alias("longitude"), F.lit(ORIGIN[1]).alias("latitude"))
    return _listings(spark, d).select("listing_id", "rent_price", "longitude", "latitude").unionByName(m, allowMissingColumns=True)


def constraint_violations(spark, d):
    x = table(spark, d, "rental_listings")
    rules = {"title": F.coalesce(qual.strip(F.col("title")), F.lit("")) != "", "seen_order": F.col("last_seen_at") >= F.col("first_seen_at"), "rent": F.col("rent_price") >= 0, "area": F.isnan("area_sqm") | (F.col("area_sqm") > 0), "latitude": F.isnan("latitude") | F.col("latitude").between(-90, 90), "longitude": F.isnan("longitude") | F.col("longitude").between(-180, 180)}
    v = x.select("listing_id", F.concat_ws(";", store.violations(rules)).alias("broken")).where("broken <> ''")
    return v.groupBy("broken").agg(F.count(F.lit(1)).alias("n"))


def map_layers(spark, d):
    q = _distances(spark, d)
    return q.groupBy("apartment_like").agg(F.count(F.lit(1)).alias("n"), F.min("longitude").alias("west"), F.max("longitude").alias("east"), F.min("latitude").alias("south"), F.max("latitude").alias("north"))


def map_visibility(spark, d):
    """Points with coordinates and how many rows are hidden for want of them."""
    x = _listings(spark, d)
    return x.agg(F.count_if(qual.present("longitude") & qual.present("latitude")).alias("visible"), F.count_if(~(qual.present("longitude") & qual.present("latitude"))).alias("hidden"))


def dashboard_metrics(spark, d):
    m = _layers(spark, d)
    b = m.where("distance_bucket is not null").groupBy("distance_bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tier").alias("tiers"), F.count_if("price_good").alias("good"))
    dim = spark.createDataFrame([(x,) for x in R.bucket_names], "distance_bucket string")
    return dim.join(b, "distance_bucket", "left").select("distance_bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "tiers", "good")])


def confidence_mean(spark, d):
    parts = [F.col(c) for c in ("parse_confidence", "price_confidence", "location_confidence", "area_confidence", "layout_confidence")]
    return table(spark, d, "rental_listings").select("listing_id", pages.overall_confidence(parts).alias("overall")).distinct()


def crawl_totals(spark, d):
    o = _observations(spark, d)
    return o.groupBy("crawl_run_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*hist.KEYS)).alias("listings"), F.count_if(F.col("rent_price").isNull()).alias("without_rent"))


def event_counts(spark, d):
    return table(spark, d, "events", "event_type", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("value") * 100)).cast("double"), 0).alias("cents"))


def times_parsed(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    iso = iso_time(F.date_format("o_orderdate", "yyyy-MM-dd"))
    ep = epoch_time(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string"))
    return o.select("o_orderkey", F.unix_timestamp(iso).alias("iso_s"), F.unix_timestamp(ep).alias("epoch_s"))


def order_price_stats(spark, d):
    """The grouped statistics on a larger table: order totals in cents per priority-like group."""
    o = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return dist.distribution_stats(o, ["l_returnflag", "l_linestatus"], "l_quantity")


def point_distances(spark, d):
    x = cut(_listings(spark, d).select("listing_id", "longitude", "latitude"))
    p = near_pairs(x, "listing_id", "longitude", "latitude", 60.0)
    j = p.join(x.withColumnsRenamed({"listing_id": "a", "longitude": "x1", "latitude": "y1"}), "a").join(x.withColumnsRenamed({"listing_id": "b", "longitude": "x2", "latitude": "y2"}), "b")
    return j.select("a", "b", F.round(haversine_m("x1", "y1", "x2", "y2"), 2).alias("metres"))


QUERIES = {f.__name__: f for f in (
    listing_scan_by_source, quality_rows, quality_summary, duplicate_groups, distance_rows, distance_bucket_summary, bucket_distribution_stats, community_distribution_stats, price_percentile_rank,
    price_area_rows, price_area_summary, nearby_pairs, nearby_stats, nearby_stats_wide, location_value_rows, location_value_summary, community_best, eps_neighborhood, eps_neighborhood_wide, geo_cluster_rows, geo_cluster_summary, top_clusters, cluster_area_label,
    price_history, price_history_summary, latest_status, latest_change, price_drops, price_rises, reconcile_partial, reconcile_full, merged_layers, faceted_filter, value_score, value_level, ranked_candidates, candidate_reasons,
    acceptance_filter, filter_reason_counts, staleness, text_numbers, text_layout, text_split, clean_texts, url_parts, props_json_parse, prefix_lookup, upsert_merge, insert_or_ignore, first_gap, union_marker,
    constraint_violations, map_layers, map_visibility, dashboard_metrics, confidence_mean, crawl_totals, event_counts, times_parsed, order_price_stats, point_distances,
)}

__all__ = ["ORACLE", "QUERIES"]
