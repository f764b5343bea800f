"""SQL for the listing queries, written independently of the operators."""

from __future__ import annotations

from rookery.rules import Rules

R = Rules()
LON, LAT = 112.42, 30.65

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _strip(c: str) -> str:
    return _STRIP.format(c)


def _hav(x1: str, y1: str, x2: str, y2: str, r: str = "6371008.8") -> str:
    return f"2 * {r} * asin(sqrt(least(1, power(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * power(sin((radians({x2}) - radians({x1})) / 2), 2))))"


L = """l AS (SELECT DISTINCT CAST(listing_id AS VARCHAR) AS listing_id, source, source_listing_id, title, description, rent_price,
  CASE WHEN NOT isnan(area_sqm) THEN area_sqm END AS area_sqm, layout, district, subdistrict, community_name,
  CASE WHEN NOT isnan(longitude) THEN longitude END AS longitude, CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude,
  published_at, host_last_login_at, first_seen_at, city, image_urls, listing_type, address_text FROM rental_listings)"""

Q = L + rf""", k AS (SELECT {_strip('title')} AS kt, rent_price AS kr, {_strip('community_name')} AS kc, count(*) AS n FROM l
  WHERE {_strip('title')} <> '' AND rent_price IS NOT NULL AND {_strip('community_name')} <> '' GROUP BY ALL HAVING count(*) > 1),
q0 AS (SELECT l.*, CASE WHEN area_sqm > 0 THEN round(rent_price / area_sqm + 1e-9, 2) END AS rent_per_sqm,
  (longitude IS NOT NULL AND latitude IS NOT NULL) AS has_location,
  coalesce(longitude BETWEEN {R.lon_range[0]} AND {R.lon_range[1]} AND latitude BETWEEN {R.lat_range[0]} AND {R.lat_range[1]}, false) AS inside,
  k.n IS NOT NULL AS possible_duplicate, {_strip('subdistrict')} AS sub,
  concat_ws(' ', nullif(title, ''), nullif(community_name, ''), nullif(description, '')) AS txt,
  regexp_matches(concat_ws(' ', nullif(title, ''), nullif(address_text, ''), nullif(community_name, ''), nullif(subdistrict, ''), nullif(description, '')), '{R.place_hint}') AS location_hint
  FROM l LEFT JOIN k ON {_strip('title')} = kt AND rent_price = kr AND {_strip('community_name')} = kc),
q1 AS (SELECT *, has_location AND NOT inside AS coordinate_suspicious,
  coalesce(NOT area_sqm BETWEEN {R.min_area} AND {R.max_area}, false) OR coalesce(NOT rent_per_sqm BETWEEN {R.min_rent_per_sqm} AND {R.max_rent_per_sqm}, false) AS area_outlier,
  sub IS NULL OR length(sub) < 3 OR regexp_matches(sub, '地铁|附近|旁$|路$|街$|^\?$') AS subdistrict_low_confidence,
  regexp_matches(txt, '{R.apartment}') AS apartment_like, published_at IS NULL AS missing_published_at,
  coalesce(rent_price BETWEEN {R.min_rent} AND {R.max_rent}, false) AS can_analyze_price,
  district IS NOT NULL AND coalesce(community_name <> '', false) AS can_analyze_region,
  published_at IS NOT NULL AS can_analyze_freshness, coalesce(community_name <> '' AND source_listing_id <> '', false) AS can_analyze_duplicates,
  rent_price IS NOT NULL AS has_price, area_sqm IS NOT NULL AS has_area, district IS NOT NULL AS has_region, layout IS NOT NULL AS has_layout, coalesce(len(image_urls) > 0, false) AS has_images,
  published_at IS NOT NULL AS has_published_at, coalesce(listing_type <> 'unknown', false) AS has_listing_type, possible_duplicate AS has_duplicate_risk FROM q0),
q2 AS (SELECT *, can_analyze_price AND area_sqm IS NOT NULL AND NOT area_outlier AS can_analyze_area_price, has_location AND NOT coordinate_suspicious AS can_analyze_map, has_location AND NOT coordinate_suspicious AS can_analyze_commute FROM q1),
q AS (SELECT *, CASE WHEN NOT can_analyze_price OR NOT can_analyze_map OR coordinate_suspicious THEN 'blocked'
  WHEN area_outlier OR subdistrict_low_confidence OR possible_duplicate OR missing_published_at THEN 'caution' ELSE 'ready' END AS tier,
  coalesce(nullif(concat_ws('; ', CASE WHEN NOT can_analyze_price THEN 'rent_out_of_range' END, CASE WHEN area_sqm IS NULL THEN 'area_missing' END, CASE WHEN area_outlier THEN 'area_outlier' END,
  CASE WHEN coordinate_suspicious AND location_hint THEN 'outside_area_but_named' WHEN coordinate_suspicious THEN 'outside_area' END, CASE WHEN NOT has_location THEN 'no_location' END, CASE WHEN subdistrict_low_confidence THEN 'vague_subdistrict' END,
  CASE WHEN apartment_like THEN 'apartment_like' END, CASE WHEN possible_duplicate THEN 'possible_duplicate' END, CASE WHEN missing_published_at THEN 'no_publication_date' END), ''), 'core_fields_usable') AS notes FROM q2)"""

D = Q + f""", dd AS (SELECT *, CASE WHEN distance_m < 4000 THEN 'near' WHEN distance_m < 8000 THEN 'middle' WHEN distance_m <= 12000 THEN 'far' ELSE 'beyond' END AS distance_bucket
  FROM (SELECT q.*, CAST(round_even({_hav('longitude', 'latitude', str(LON), str(LAT), '6371000.0')}, 0) AS INTEGER) AS distance_m FROM q WHERE can_analyze_map))"""

C = D + """, c AS (SELECT listing_id, community_name, longitude, latitude, distance_bucket, rent_price, rent_per_sqm, apartment_like, possible_duplicate FROM dd
  WHERE tier <> 'blocked' AND can_analyze_price AND can_analyze_area_price)"""


def _at(v: str, p: float) -> str:
    return f"list_sort(list({v}))[CAST(round_even((count({v}) - 1) * {p}, 0) AS INTEGER) + 1]"


def _stats(v: str) -> str:
    q1, q3 = _at(v, 0.25), _at(v, 0.75)
    return f"count({v}) AS n, round(CAST(min({v}) AS DOUBLE), 2) AS min, round(CAST({q1} AS DOUBLE), 2) AS p25, CAST(round(CAST(median({v}) AS DECIMAL(28, 6)), 2) AS DOUBLE) AS median, round(CAST({q3} AS DOUBLE), 2) AS p75, round(CAST(max({v}) AS DOUBLE), 2) AS max, round(CAST({q3} - {q1} AS DOUBLE), 2) AS iqr"


def _rank(v: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY distance_bucket) = 1 THEN 0.0 ELSE round((count(*) OVER (PARTITION BY distance_bucket ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) / CAST(count(*) OVER (PARTITION BY distance_bucket) - 1 AS DOUBLE), 4) END"


def _labels(s: str, v: str) -> str:
    return f"{s}.median AS {s}_median, round({v} - {s}.median, 2) AS {s}_delta, {v} <= {s}.p25 AS {s}_good, {v} >= {s}.p75 AS {s}_expensive, {v} < {s}.p25 - 1.5 * {s}.iqr AS {s}_low_outlier, {v} > {s}.p75 + 1.5 * {s}.iqr AS {s}_high_outlier"


PA = C + f""", price AS (SELECT distance_bucket, {_stats('rent_price')} FROM c GROUP BY 1), rps AS (SELECT distance_bucket, {_stats('rent_per_sqm')} FROM c GROUP BY 1),
cp AS (SELECT community_name, {_stats('rent_price')} FROM c WHERE community_name IS NOT NULL GROUP BY 1), cr AS (SELECT community_name, {_stats('rent_per_sqm')} FROM c WHERE community_name IS NOT NULL GROUP BY 1),
ranks AS (SELECT listing_id, {_rank('rent_price')} AS price_percentile, {_rank('rent_per_sqm')} AS rps_percentile FROM c),
pa AS (SELECT c.listing_id, c.distance_bucket, {_labels('price', 'rent_price')}, {_labels('rps', 'rent_per_sqm')}, price_percentile, rps_percentile, coalesce(cp.n, 0) AS community_n,
  CASE WHEN cp.n >= {R.min_community} THEN cp.median END AS community_price_median, CASE WHEN cr.n >= {R.min_community} THEN cr.median END AS community_rps_median,
  concat_ws('; ', CASE WHEN price_good THEN 'rent_at_or_below_p25' END, CASE WHEN rps_good THEN 'area_rent_at_or_below_p25' END, CASE WHEN price_expensive THEN 'rent_at_or_above_p75' END, CASE WHEN rps_expensive THEN 'area_rent_at_or_above_p75' END,
  CASE WHEN price_low_outlier OR rps_low_outlier THEN 'low_outlier' END, CASE WHEN price_high_outlier OR rps_high_outlier THEN 'high_outlier' END,
  CASE WHEN apartment_like THEN 'apartment_like' END, CASE WHEN possible_duplicate THEN 'possible_duplicate' END, CASE WHEN cp.n >= {R.min_community} THEN 'community_compared' END) AS notes
  FROM c JOIN price USING (distance_bucket) JOIN rps USING (distance_bucket) JOIN ranks USING (listing_id) LEFT JOIN cp USING (community_name) LEFT JOIN cr USING (community_name))"""


def _pairs(src: str, r: float) -> str:
    return f"pr AS (SELECT a.listing_id AS a, b.listing_id AS b FROM {src} a JOIN {src} b ON a.listing_id <> b.listing_id AND b.latitude BETWEEN a.latitude - {r / 110000} AND a.latitude + {r / 110000} WHERE {_hav('a.longitude', 'a.latitude', 'b.longitude', 'b.latitude')} <= {r})"


LV = C + ", " + _pairs("c", R.nearby_m) + f""", nb AS (SELECT a AS listing_id, {_stats('rent_price')} FROM pr JOIN c ON c.listing_id = b GROUP BY 1), nr AS (SELECT a AS listing_id, {_stats('rent_per_sqm')} FROM pr JOIN c ON c.listing_id = b GROUP BY 1),
cm AS (SELECT community_name, {_stats('rent_price')} FROM c WHERE community_name IS NOT NULL GROUP BY 1), cs AS (SELECT community_name, min(rent_per_sqm) AS least FROM c WHERE community_name IS NOT NULL GROUP BY 1),
lv AS (SELECT c.listing_id, coalesce(nb.n, 0) AS nearby_n, CASE WHEN nb.n >= {R.min_nearby} THEN nb.median END AS nearby_price_median, CASE WHEN nb.n >= {R.min_nearby} THEN nr.median END AS nearby_rps_median,
  CASE WHEN nb.n >= {R.min_nearby} THEN round(rent_price - nb.median, 2) END AS price_delta_from_nearby, coalesce(nb.n >= {R.min_nearby} AND rent_price < nb.median, false) AS below_nearby_median,
  coalesce(nb.n >= {R.min_nearby} AND rent_per_sqm < nr.median, false) AS nearby_good_value, coalesce(nb.n >= {R.min_nearby} AND rent_per_sqm >= nr.p75, false) AS nearby_expensive,
  coalesce(cm.n, 0) AS community_n, CASE WHEN cm.n >= {R.min_community} THEN cm.median END AS community_price_median, coalesce(cm.n >= {R.min_community} AND rent_price < cm.median, false) AS below_community_median,
  coalesce(cm.n >= {R.min_community} AND rent_price > cm.median, false) AS above_community_median, coalesce(cm.n >= {R.min_community} AND rent_price = cm.min, false) AS best_price_in_community,
  coalesce(cm.n >= {R.min_community} AND rent_per_sqm = cs.least, false) AS best_area_price_in_community,
  concat_ws('; ', CASE WHEN coalesce(nb.n, 0) < {R.min_nearby} THEN 'few_neighbours' END, CASE WHEN below_nearby_median THEN 'rent_below_neighbours' END, CASE WHEN nearby_good_value THEN 'area_rent_below_neighbours' END, CASE WHEN nearby_expensive THEN 'area_rent_at_or_above_neighbours_p75' END,
  CASE WHEN below_community_median THEN 'rent_below_community' END, CASE WHEN best_price_in_community THEN 'least_rent_in_community' END, CASE WHEN best_area_price_in_community THEN 'least_area_rent_in_community' END,
  CASE WHEN apartment_like THEN 'apartment_like' END, CASE WHEN possible_duplicate THEN 'possible_duplicate' END) AS notes
  FROM c LEFT JOIN nb USING (listing_id) LEFT JOIN nr USING (listing_id) LEFT JOIN cm USING (community_name) LEFT JOIN cs USING (community_name))"""

def _mean(c: str) -> str:
    """Mean of a coordinate, 6 places, halves up, from whole nanodegrees."""
    top, n = f"(2 * CAST(sum(CAST(round({c} * 1e9) AS HUGEINT)) AS HUGEINT) + 1000 * count(*))", "(2000 * count(*))"
    return f"CAST(({top} - ({top} % {n} + {n}) % {n}) // {n} AS DOUBLE) / 1e6"


M = "m AS (SELECT * FROM q WHERE can_analyze_map)"
# WITH RECURSIVE: the closure of core points under core neighbours
G = Q + ", " + M + ", " + _pairs("m", R.eps_m) + f""", deg AS (SELECT m.listing_id, longitude, latitude, count(pr.b) AS nb, count(pr.b) + 1 >= {R.min_samples} AS is_core FROM m LEFT JOIN pr ON pr.a = m.listing_id GROUP BY ALL),
ce AS (SELECT a, b FROM pr WHERE a IN (SELECT listing_id FROM deg WHERE is_core) AND b IN (SELECT listing_id FROM deg WHERE is_core)),
walk(id, root) AS (SELECT listing_id, listing_id FROM deg WHERE is_core UNION SELECT ce.b, walk.root FROM walk JOIN ce ON ce.a = walk.id AND walk.root < ce.b),
roots AS (SELECT id, min(root) AS root FROM walk GROUP BY 1), names AS (SELECT root, row_number() OVER (ORDER BY root) AS no FROM (SELECT DISTINCT root FROM roots)),
corec AS (SELECT id, no FROM roots JOIN names USING (root)), bord AS (SELECT a AS id, min(no) AS no FROM pr JOIN corec ON corec.id = b GROUP BY 1),
asg AS (SELECT deg.*, CASE WHEN is_core THEN corec.no ELSE bord.no END AS no FROM deg LEFT JOIN corec ON corec.id = listing_id LEFT JOIN bord ON bord.id = listing_id),
sz AS (SELECT no, count(*) AS size, {_mean('longitude')} AS lo, {_mean('latitude')} AS la FROM asg WHERE no IS NOT NULL GROUP BY 1),
g AS (SELECT listing_id, CASE WHEN no IS NULL THEN 'noise' ELSE printf('c%05d', no) END AS cluster, coalesce(size, 0) AS cluster_size, is_core, nb AS neighbour_count, lo AS centroid_lon, la AS centroid_lat,
  CAST(round_even({_hav('longitude', 'latitude', 'lo', 'la', '6371000.0')}, 0) AS INTEGER) AS centroid_m,
  concat_ws('; ', CASE WHEN no IS NULL THEN 'outside_all_clusters' WHEN is_core THEN 'core_point' ELSE 'border_point' END, CASE WHEN size >= {R.dense_cluster} THEN 'dense_cluster' WHEN size < {2 * R.min_samples} THEN 'small_cluster' END) AS notes FROM asg LEFT JOIN sz USING (no))"""

T = "coalesce(crawl_run_id, 1073741824), coalesce(rent_price, -1), coalesce(availability_status, '')"
O = "o AS (SELECT DISTINCT source, source_listing_id, observed_at, crawl_run_id, rent_price, availability_status, days_on_market FROM listing_observations WHERE observed_at IS NOT NULL)"
H = O + f""", h0 AS (SELECT *, last_value(rent_price IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_price, first_value(rent_price IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_price,
  min(rent_price) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lowest_price, row_number() OVER w AS seq FROM o WINDOW w AS (PARTITION BY source, source_listing_id ORDER BY observed_at, {T}, coalesce(days_on_market, -1))),
h AS (SELECT *, epoch_us(observed_at) AS observed_us, rent_price - previous_price AS delta, round((rent_price - previous_price) / CAST(nullif(previous_price, 0) AS DOUBLE), 4) AS delta_share, rent_price - first_price AS delta_from_first, rent_price - lowest_price AS delta_from_lowest,
  CASE WHEN rent_price < previous_price THEN 'down' WHEN rent_price > previous_price THEN 'up' WHEN rent_price = previous_price THEN 'unchanged' ELSE 'first_or_unknown' END AS direction FROM h0)"""
S = O + f""", st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_listing_id ORDER BY observed_at DESC, {T}) AS rn FROM o) WHERE rn = 1)"""

def _ml(clusters: bool) -> str:
    base = PA + ", " + LV[len(C) + 2 :]
    if not clusters:
        return base + ML_ROWS.format("", "", "pr")
    return base.replace(" pr AS (", " prn AS (").replace(" FROM pr JOIN", " FROM prn JOIN") + ", " + G[len(Q) + 2 :] + ML_ROWS.format(", cluster, cluster_size, is_core, neighbour_count, centroid_lon, centroid_lat", " LEFT JOIN g USING (listing_id)", "prn")


ML_ROWS = """, ml AS (SELECT q.listing_id, q.rent_price, q.area_sqm, q.rent_per_sqm, q.tier, q.apartment_like, q.possible_duplicate, q.notes, dd.distance_m, dd.distance_bucket, price_good, rps_good, price_expensive, nearby_n, below_nearby_median, nearby_good_value, dd.longitude AS longitude, dd.latitude AS latitude{0}
  FROM q LEFT JOIN dd USING (listing_id) LEFT JOIN pa USING (listing_id) LEFT JOIN lv USING (listing_id){1})"""
ML = _ml(False)
F = ML + ", f AS (SELECT * FROM ml WHERE rent_price BETWEEN 1500 AND 9000 AND area_sqm BETWEEN 15 AND 150 AND distance_bucket IN ('near', 'middle') AND tier IN ('ready', 'caution') AND NOT possible_duplicate)"


def _scale(c: str, good: bool) -> str:
    x = f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN (CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
    return f"coalesce({x if good else '1 - ' + x}, 0.5)"


V = F + f""", v0 AS (SELECT *, round(({_scale('area_sqm', True)} * 0.45 + {_scale('distance_m', False)} * 0.35 + {_scale('rent_price', False)} * 0.2) * 100, 1) AS value_score FROM f),
vq AS (SELECT round(quantile_cont(value_score, 0.3), 9) AS lo, round(quantile_cont(value_score, 0.7), 9) AS hi FROM v0),
v AS (SELECT v0.*, CASE WHEN lo = hi THEN 'neutral' WHEN value_score >= hi THEN 'high' WHEN value_score <= lo THEN 'low' ELSE 'neutral' END AS value_level FROM v0, vq)"""
W = L + f""", a AS (SELECT listing_id, concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(district, ''), nullif(subdistrict, ''), nullif(community_name, '')) AS t, rent_price FROM l),
w AS (SELECT listing_id, list_filter([CASE WHEN rent_price IS NULL THEN 'no_rent' END, CASE WHEN rent_price < 1500 THEN 'rent_low' END, CASE WHEN rent_price > 6000 THEN 'rent_high' END, CASE WHEN contains(t, '短租') THEN 'short_let' END, CASE WHEN regexp_matches(t, '{R.apartment}') THEN 'apartment' END], lambda x: x IS NOT NULL) AS why FROM a)"""


# every row of every snapshot, the snapshots in the order of their dates
SNAPS = """s AS (SELECT snapshot_date, source, source_listing_id, title, rent_price, epoch_us(last_seen_at) AS first_us,
  row(snapshot_date, epoch_us(last_seen_at), epoch_us(delivered_at), coalesce(rent_price, -1), coalesce(title, '')) AS seq FROM listing_snapshots WHERE source IS NOT NULL AND source_listing_id IS NOT NULL)"""
_HAS = "has_price, has_area, has_location, has_region, has_layout, has_images, has_published_at, has_listing_type, has_duplicate_risk"
_FL = "can_analyze_price, can_analyze_area_price, can_analyze_map, can_analyze_commute, can_analyze_region, can_analyze_freshness, can_analyze_duplicates, area_outlier, subdistrict_low_confidence, apartment_like, possible_duplicate, missing_published_at, coordinate_suspicious"
_QC = f"listing_id, rent_per_sqm, {_HAS}, {_FL}, location_hint, tier, notes"
_FLAGS = _FL.split(", ")
_PAL = [f"{s}_{x}" for s in ("price", "rps") for x in ("good", "expensive", "low_outlier", "high_outlier")]
_LVF = ["below_nearby_median", "nearby_good_value", "nearby_expensive", "below_community_median", "above_community_median", "best_price_in_community", "best_area_price_in_community"]
_DIG = "regexp_extract_all(replace(description, ',', ''), '[0-9]+')"
_CLEAN = r"regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\s\p{Z}\x{0085}\x{000B}]+', ' ', 'g')"
_LAY = "translate(layout, '０１２３４５６７８９', '0123456789')"


def _cnt(cs: list[str]) -> str:
    return ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in cs)


ORACLE = {
    "listing_scan_by_source": f"WITH {L} SELECT listing_id, title, rent_price, district FROM l WHERE source = 'ugc_c'",
    "quality_rows": f"WITH {Q} SELECT {_QC} FROM q",
    "quality_summary": f"WITH {Q} SELECT count(*) AS total, {', '.join(f'count(*) FILTER (tier = {t!r}) AS tier_{t}' for t in ('ready', 'caution', 'blocked'))}, {_cnt(_FLAGS)} FROM q",
    "duplicate_groups": f"WITH {L} SELECT * FROM (SELECT {_strip('layout')} AS layout, rent_price, {_strip('community_name')} AS community, count(*) AS n FROM l GROUP BY ALL) WHERE n > 1 AND layout <> '' AND rent_price IS NOT NULL AND community <> ''",
    "distance_rows": f"WITH {D} SELECT listing_id, distance_m, distance_bucket FROM dd",
    "distance_bucket_summary": f"WITH {D} SELECT count(*) AS total, {', '.join(f'count(*) FILTER (distance_bucket = {b!r}) AS {b}' for b in R.bucket_names)} FROM dd",
    "bucket_distribution_stats": f"WITH {C} SELECT distance_bucket, {_stats('rent_price')} FROM c GROUP BY 1",
    "community_distribution_stats": f"WITH {C} SELECT * FROM (SELECT community_name, {_stats('rent_per_sqm')} FROM c WHERE community_name IS NOT NULL GROUP BY 1) WHERE n >= {R.min_community}",
    "price_percentile_rank": f"WITH {C} SELECT listing_id, distance_bucket, {_rank('rent_price')} AS percentile FROM c",
    "price_area_rows": f"WITH {PA} SELECT * FROM pa",
    "price_area_summary": f"WITH {PA} SELECT distance_bucket, count(*) AS n, {_cnt([*_PAL, 'apartment_like', 'possible_duplicate'])} FROM pa JOIN c USING (listing_id, distance_bucket) GROUP BY 1",
    "nearby_pairs": f"WITH {C}, {_pairs('c', R.nearby_m)} SELECT a, b FROM pr WHERE a < b",
    "nearby_stats": f"WITH {LV} SELECT listing_id, n, median, p75 FROM nb",
    "nearby_stats_wide": f"WITH {C}, {_pairs('c', 1000.0)}, nb AS (SELECT a AS listing_id, {_stats('rent_price')} FROM pr JOIN c ON c.listing_id = b GROUP BY 1) SELECT listing_id, n, median, p75 FROM nb",
    "location_value_rows": f"WITH {LV} SELECT * FROM lv",
    "location_value_summary": f"WITH {LV} SELECT count(*) AS total, {_cnt(_LVF)}, count(*) FILTER (nearby_n >= {R.min_nearby}) AS with_nearby, count(*) FILTER (community_n >= {R.min_community}) AS with_community FROM lv",
    "community_best": f"WITH {LV} SELECT listing_id, community_n FROM lv WHERE best_price_in_community",
    "eps_neighborhood": f"WITH RECURSIVE {G} SELECT listing_id, nb + 1 AS n_with_self FROM deg",
    "eps_neighborhood_wide": f"WITH {Q}, {M}, {_pairs('m', 800.0)} SELECT m.listing_id, count(pr.b) + 1 AS n_with_self FROM m LEFT JOIN pr ON pr.a = m.listing_id GROUP BY 1",
    "geo_cluster_rows": f"WITH RECURSIVE {G} SELECT * FROM g",
    "geo_cluster_summary": f"WITH RECURSIVE {G} SELECT count(*) AS total, count(*) FILTER (cluster = 'noise') AS noise, count(*) FILTER (is_core) AS core, (SELECT count(*) FROM sz) AS clusters, (SELECT coalesce(max(size), 0) FROM sz) AS largest, (SELECT coalesce(min(size), 0) FROM sz) AS smallest, (SELECT coalesce(median(size), 0.0) FROM sz) AS median_size FROM g",
    "top_clusters": f"WITH RECURSIVE {G} SELECT cluster, count(*) AS n FROM g WHERE cluster <> 'noise' GROUP BY 1 ORDER BY n DESC, cluster LIMIT 10",
    "cluster_area_label": f"WITH RECURSIVE {G}, x AS (SELECT g.cluster, l.community_name, l.subdistrict, l.district FROM g JOIN l USING (listing_id) WHERE g.cluster <> 'noise'), "
    + ", ".join(f"t{i} AS (SELECT cluster, {c} AS v FROM (SELECT cluster, {c}, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {c}) AS rn FROM x WHERE coalesce({c}, '') <> '' GROUP BY cluster, {c}) WHERE rn = 1)" for i, c in enumerate(("community_name", "subdistrict", "district")))
    + " SELECT y.cluster, coalesce(t0.v, t1.v, t2.v) AS name FROM (SELECT DISTINCT cluster FROM x) y LEFT JOIN t0 USING (cluster) LEFT JOIN t1 USING (cluster) LEFT JOIN t2 USING (cluster)",
    "price_history": f"WITH {H} SELECT source, source_listing_id, observed_us, rent_price, previous_price, first_price, lowest_price, delta, delta_share, delta_from_first, delta_from_lowest, direction FROM h",
    "price_history_summary": f"WITH {H}, {S[len(O) + 2:]} SELECT count(*) AS observations, count(*) FILTER (delta <> 0) AS changes, count(*) FILTER (delta < 0) AS drops, count(*) FILTER (delta > 0) AS rises, (SELECT count(*) FROM st) AS listings, (SELECT count(*) FROM st WHERE availability_status <> 'active') AS inactive_latest FROM h",
    "latest_status": f"WITH {S} SELECT source, source_listing_id, epoch_us(observed_at) AS observed_us, availability_status, rent_price FROM st",
    "latest_change": f"WITH {H} SELECT source, source_listing_id, arg_max(observed_us, seq) FILTER (delta <> 0) AS changed_us, arg_max(delta, seq) FILTER (delta <> 0) AS latest_delta, arg_max(rent_price, seq) FILTER (rent_price IS NOT NULL) AS latest_price FROM h GROUP BY 1, 2",
    "price_drops": f"WITH {H} SELECT source, source_listing_id, observed_us, delta, delta_share FROM h WHERE delta < 0",
    "price_rises": f"WITH {H} SELECT source, source_listing_id, observed_us, delta, delta_share FROM h WHERE delta > 0",
    "reconcile_partial": f"WITH {L}, {S}, sc AS (SELECT DISTINCT source, source_listing_id FROM l WHERE rent_price BETWEEN {R.min_rent} AND {R.max_rent} AND district IS NOT NULL) SELECT sc.source, sc.source_listing_id, st.availability_status AS previous, 'out_of_window' AS status FROM sc LEFT JOIN st USING (source, source_listing_id) WHERE NOT EXISTS (SELECT 1 FROM listing_snapshots s WHERE s.snapshot_date = (SELECT max(snapshot_date) FROM listing_snapshots) AND s.source = sc.source AND s.source_listing_id = sc.source_listing_id) AND st.availability_status IS DISTINCT FROM 'out_of_window'",
    "reconcile_full": f"WITH {S}, sc AS (SELECT DISTINCT source, source_listing_id FROM listing_snapshots WHERE snapshot_date = DATE '2026-05-16'), se AS (SELECT DISTINCT source, source_listing_id FROM listing_snapshots WHERE snapshot_date <> DATE '2026-05-16'), ab AS (SELECT sc.*, st.availability_status AS p FROM sc LEFT JOIN st USING (source, source_listing_id) WHERE (sc.source, sc.source_listing_id) NOT IN (SELECT (source, source_listing_id) FROM se)) SELECT (SELECT count(*) FROM sc) AS scope_total, (SELECT count(*) FROM se) AS seen_unique, (SELECT count(*) FROM se) >= (SELECT count(*) FROM sc) AS is_full, count(*) FILTER (p IS DISTINCT FROM 'offline') AS newly_offline, count(*) FILTER (p = 'offline') AS already_offline, 0 AS newly_out_of_window, 0 AS already_out_of_window, (SELECT count(*) FROM sc) - count(*) AS in_scope_seen FROM ab",
    "merged_layers": f"WITH RECURSIVE {_ml(True)} SELECT * FROM ml",
    "faceted_filter": f"WITH {F} SELECT listing_id, rent_price, distance_bucket, tier FROM f",
    "value_score": f"WITH {V} SELECT listing_id, value_score FROM v",
    "value_level": f"WITH {V} SELECT value_level, count(*) AS n FROM v GROUP BY 1",
    "ranked_candidates": f"WITH {V} SELECT listing_id, value_score, distance_m FROM v ORDER BY value_score DESC NULLS LAST, nearby_good_value DESC NULLS LAST, price_good DESC NULLS LAST, distance_m ASC NULLS LAST, listing_id LIMIT 20",
    "candidate_reasons": f"WITH {V} SELECT listing_id, coalesce(nullif(concat_ws('; ', CASE WHEN tier = 'ready' THEN 'tier_ready' END, CASE WHEN value_level = 'high' THEN 'high_score' END, CASE WHEN price_good THEN 'low_price' END, CASE WHEN rps_good THEN 'low_area_price' END, CASE WHEN nearby_good_value THEN 'below_nearby_area_price' END, CASE WHEN below_nearby_median THEN 'below_nearby_price' END), ''), 'neutral') AS reasons, coalesce(nullif(concat_ws('; ', CASE WHEN tier = 'caution' THEN 'tier_caution' END, CASE WHEN apartment_like THEN 'apartment_like' END, CASE WHEN nearby_n < {R.min_nearby} THEN 'few_neighbours' END), ''), 'none_known') AS risks FROM v",
    "acceptance_filter": f"WITH {W} SELECT listing_id, len(why) = 0 AS accepted, array_to_string(why, '; ') AS reasons FROM w",
    "filter_reason_counts": f"WITH {W} SELECT reason, count(*) AS n FROM (SELECT unnest(why) AS reason FROM w) GROUP BY 1",
    "staleness": f"WITH {L}, d AS (SELECT listing_id, CAST(floor((epoch(TIMESTAMPTZ '2026-06-01 00:00:00+00') - floor(epoch(host_last_login_at))) / 86400) AS INTEGER) AS days, date_diff('day', CAST(host_last_login_at + INTERVAL 8 HOUR AS DATE), DATE '2026-06-01') AS local_days FROM l) SELECT *, CASE WHEN days < 30 THEN 'fresh' WHEN days < 90 THEN 'aging' WHEN days IS NOT NULL THEN 'stale' END AS class FROM d",
    "text_numbers": f"WITH {L} SELECT listing_id, TRY_CAST(nullif(regexp_extract(replace(description, ',', ''), '[0-9]+'), '') AS INTEGER) AS first_int, list_min(list_transform({_DIG}, lambda x: TRY_CAST(x AS INTEGER))) AS low, list_max(list_transform({_DIG}, lambda x: TRY_CAST(x AS INTEGER))) AS high, len({_DIG}) AS n FROM l WHERE description IS NOT NULL",
    "text_layout": f"WITH {L} SELECT listing_id, " + ", ".join(f"TRY_CAST(nullif(regexp_extract({_LAY}, '{p}', 1), '') AS INTEGER) AS {n}" for n, p in (("rooms", "([0-9]+)[室房]"), ("halls", "([0-9]+)厅"), ("baths", "([0-9]+)卫"))) + " FROM l",
    "text_split": rf"WITH {L}, t AS (SELECT listing_id, {_strip('title')} AS t, community_name FROM l) SELECT listing_id, nullif(regexp_extract(t, '^([^\s\p{{Z}}]*)', 1), '') AS head, CASE WHEN regexp_matches(t, '[\s\p{{Z}}]') THEN regexp_extract(t, '^[^\s\p{{Z}}]*[\s\p{{Z}}]+(.*)$', 1) END AS rest, nullif({_strip("regexp_extract(community_name, '^([^-/·]*)', 1)")}, '') AS part FROM t",
    "clean_texts": f"WITH c AS (SELECT doc_id, {_strip(_CLEAN)} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(t) AS clean_hash, length(t) AS n FROM c",
    "url_parts": "SELECT DISTINCT listing_id, nullif(regexp_extract(source_url, '^[a-z]+://([^/:?#]+)', 1), '') AS host, nullif(regexp_extract(source_url, '^[a-z]+://[^/?#]+[^?#]*/([0-9]+)/?(?:[?#]|$)', 1), '') AS trailing_id FROM rental_listings",
    "props_json_parse": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "prefix_lookup": "WITH t AS (SELECT p, min(name) AS name FROM (SELECT substr(name, 1, 2) AS p, name FROM ref_subdistricts UNION ALL SELECT name, name FROM ref_subdistricts) GROUP BY 1), v AS (SELECT DISTINCT subdistrict FROM rental_listings WHERE subdistrict IS NOT NULL) SELECT subdistrict, (SELECT arg_max(name, length(p)) FROM t WHERE starts_with(v.subdistrict, p)) AS mapped FROM v",
    "upsert_merge": f"WITH {SNAPS} SELECT source, source_listing_id, x.t AS title, x.r AS rent_price, first_us FROM (SELECT source, source_listing_id, arg_max(struct_pack(t := title, r := rent_price), seq) AS x, arg_min(first_us, seq) AS first_us FROM s GROUP BY ALL)",
    "insert_or_ignore": f"WITH {SNAPS}, f AS (SELECT DISTINCT source, source_listing_id FROM s WHERE snapshot_date = (SELECT min(snapshot_date) FROM listing_snapshots)) SELECT source, source_listing_id, x.t AS title, x.r AS rent_price FROM (SELECT source, source_listing_id, arg_min(struct_pack(t := title, r := rent_price), seq) AS x FROM s GROUP BY 1, 2) z WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source = z.source AND f.source_listing_id = z.source_listing_id)",
    "first_gap": "WITH p AS (SELECT DISTINCT crawl_run_id AS n FROM listing_observations WHERE crawl_run_id > 0 UNION SELECT 0) SELECT min(n) + 1 AS next FROM p WHERE n + 1 NOT IN (SELECT n FROM p)",
    "union_marker": f"WITH {L} SELECT listing_id, rent_price, longitude, latitude FROM l UNION ALL SELECT 'origin', NULL, {LON}, {LAT}",
    "constraint_violations": f"SELECT broken, count(*) AS n FROM (SELECT concat_ws(';', CASE WHEN coalesce({_strip('title')}, '') = '' THEN 'title' END, CASE WHEN last_seen_at < first_seen_at THEN 'seen_order' END, CASE WHEN rent_price < 0 THEN 'rent' END, CASE WHEN NOT isnan(area_sqm) AND area_sqm <= 0 THEN 'area' END, CASE WHEN NOT isnan(latitude) AND abs(latitude) > 90 THEN 'latitude' END, CASE WHEN NOT isnan(longitude) AND abs(longitude) > 180 THEN 'longitude' END) AS broken FROM rental_listings) WHERE broken <> '' GROUP BY 1",
    "map_layers": f"WITH {D} SELECT apartment_like, count(*) AS n, min(longitude) AS west, max(longitude) AS east, min(latitude) AS south, max(latitude) AS north FROM dd GROUP BY 1",
    "map_visibility": f"WITH {L} SELECT count(*) FILTER (longitude IS NOT NULL AND latitude IS NOT NULL) AS visible, count(*) FILTER (longitude IS NULL OR latitude IS NULL) AS hidden FROM l",
    "dashboard_metrics": f"WITH {ML} SELECT b AS distance_bucket, count(ml.listing_id) AS n, count(DISTINCT tier) AS tiers, count(*) FILTER (price_good) AS good FROM (SELECT unnest(['near', 'middle', 'far', 'beyond']) AS b) LEFT JOIN ml ON distance_bucket = b GROUP BY 1",
    "confidence_mean": "SELECT DISTINCT listing_id, round(coalesce(list_avg(list_filter([parse_confidence, price_confidence, location_confidence, area_confidence, layout_confidence], lambda x: x > 0)), 0.0), 4) AS overall FROM rental_listings",
    "crawl_totals": f"WITH {O.replace(' WHERE observed_at IS NOT NULL', '')} SELECT crawl_run_id, count(*) AS rows, count(DISTINCT (source, source_listing_id)) AS listings, count(*) FILTER (rent_price IS NULL) AS without_rent FROM o GROUP BY 1",
    "event_counts": "SELECT event_type, count(*) AS n, round(sum(round(value * 100)), 0) AS cents FROM events GROUP BY 1",
    "times_parsed": "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS iso_s, CAST(epoch(o_orderdate) AS BIGINT) AS epoch_s FROM orders",
    "order_price_stats": f"SELECT l_returnflag, l_linestatus, {_stats('l_quantity')} FROM lineitem GROUP BY 1, 2",
    "point_distances": f"WITH {L}, p AS (SELECT DISTINCT listing_id, longitude AS x, latitude AS y FROM l WHERE longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90 AND NOT (longitude = 0 AND latitude = 0)) SELECT a.listing_id AS a, b.listing_id AS b, round({_hav('a.x', 'a.y', 'b.x', 'b.y')}, 2) AS metres FROM p a JOIN p b ON a.listing_id < b.listing_id AND b.y BETWEEN a.y - 0.001 AND a.y + 0.001 WHERE {_hav('a.x', 'a.y', 'b.x', 'b.y')} <= 60",
}
