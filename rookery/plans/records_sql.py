"""SQL for the queries of pages, files, fields and streams, written independently of the operators."""

from __future__ import annotations

from rookery.plans.listings_sql import C, D, G, H, L, LAT, LON, LV, ORACLE as LISTINGS, PA, S, T, V, _strip
from rookery.rules import Rules
from rookery.sinks import FILTER_COLUMNS, REVIEWER_COLUMNS, VALIDATION_COLUMNS

R = Rules()
_NUM = "CAST(CASE WHEN NOT isnan({0}) THEN {0} END AS DECIMAL(18, 4))"
_WS = r"[\s\p{{Z}}\x{{0085}}\x{{000B}}\x{{001C}}-\x{{001F}}]+"
B = f"b AS (SELECT listing_id, title, rent_price, {_NUM.format('area_sqm')} AS area, layout, district, subdistrict, community_name, longitude, latitude, image_urls, last_seen_at FROM rental_listings)"
ONE = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY last_seen_at DESC NULLS LAST) AS rn FROM rental_listings) WHERE rn = 1)"


def _clean(c: str) -> str:
    return f"regexp_replace({c}, '{_WS.format()}', ' ', 'g')"


def _tidy(c: str) -> str:
    return _strip(_clean(c))


def _layout_int(c: str, p: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({c}, '{p}', 1), '') AS INTEGER)"


_VAL = ", ".join(("coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S'), '')" if c == "published_at" else f"coalesce({c}, '')" if c in ("source", "source_type", "source_listing_id", "source_url", "title", "city", "district", "subdistrict", "community_name", "rent_price_unit", "currency", "layout", "floor", "deposit", "subway_info") else c) + f" AS {n}" for c, n in VALIDATION_COLUMNS.items())
_REV = ", ".join(f"'' AS \"{c}\"" for c in REVIEWER_COLUMNS)
_FIL = [c for c in FILTER_COLUMNS if c not in ("accepted", "reasons", "source_url", "parse_confidence")]
_WHY = "concat_ws('; ', CASE WHEN rent_price IS NULL THEN 'no_rent' END, CASE WHEN area_sqm IS NULL THEN 'no_area' END, CASE WHEN district IS NULL THEN 'no_district' END)"
_DIST = "'^([一-鿿]{2}区)([^的]*)(?:的(.*))?$'"
_LOC = "regexp_replace(coalesce(district, 'x') || coalesce(replace(subdistrict, '的', ''), '') || CASE WHEN community_name IS NOT NULL THEN '的' || community_name ELSE '' END, '[\n\r]', '', 'g')"
_UNITS, _NAMES = "弄|幢|号|栋|楼|期|村|区|座|组|苑|园|庄|阁|轩|庭|城|都|汇|路|街|道|里", "社区|小区|新村|公寓|大厦|大楼|名邸|花园|中心|广场"
_WORDS = r"'[^A-Za-z]+'"


def _one(c: str, unit: str) -> str:
    return f"coalesce(format('{{:.1f}}', CAST(round(CAST({c} AS DECIMAL(18, 6)), 1) AS DOUBLE)) || ' {unit}', '-')"


# the orders of all price changes of one id, whatever its source
CARDS = H + f""", {L}, k AS (SELECT source_listing_id, arg_max(rent_price, row(observed_at, source, {T}, coalesce(days_on_market, -1))) FILTER (rent_price IS NOT NULL) AS rent,
  arg_max(struct_pack(delta := delta, previous_price := previous_price, rent_price := rent_price), row(observed_at, source, {T}, coalesce(days_on_market, -1))) FILTER (delta <> 0) AS m FROM h WHERE source_listing_id IS NOT NULL GROUP BY 1),
cd AS (SELECT l.listing_id, coalesce(k.rent, l.rent_price) AS rent_price, CAST(host_last_login_at + INTERVAL 8 HOUR AS DATE) AS seen, m.delta AS dl, m.previous_price AS pp, m.rent_price AS rp FROM l LEFT JOIN k USING (source_listing_id))"""

ORACLE = {
    "page_cards": f"WITH {B} SELECT listing_id AS page_id, 0 AS position, CAST(listing_id AS VARCHAR) AS item_id, '/x/' || listing_id AS href, {_tidy('title')} AS title, rent_price AS rent, CAST(area AS DOUBLE) AS area, {_layout_int('layout', '([0-9]+)[室房]')} AS rooms FROM b WHERE {_tidy('title')} <> ''",
    "page_ld_detail": f"WITH {B} SELECT DISTINCT listing_id AS page_id, title, rent_price AS rent, 'CNY' AS currency, CAST(area AS DOUBLE) AS area, district, longitude, latitude, array_to_string(coalesce(image_urls, []), ' ') AS images FROM b",
    "page_ld_list": f"WITH {B}, s AS (SELECT *, unnest(['', '/photos', '0/']) AS e FROM b) SELECT listing_id AS page_id, 'https://h.example/r/' || listing_id || e AS url, CASE e WHEN '' THEN CAST(listing_id AS VARCHAR) WHEN '0/' THEN listing_id || '0' END AS item_id, {_strip('title')} AS title, rent_price AS rent, strftime(last_seen_at, '%Y-%m-%d') AS posted FROM s",
    "page_summary": f"WITH {B}, i AS (SELECT listing_id, title, list_concat(['https://h.example/x/' || listing_id], coalesce(image_urls, [])) AS ls FROM b) SELECT listing_id AS page_id, nullif({_tidy('title')}, '') AS title, array_to_string(list_filter(ls, lambda x, n: list_position(ls, x) = n)[1:20], ' ') AS links FROM i",
    "page_hash": "SELECT DISTINCT listing_id, sha256('<p>' || coalesce(title, '') || '</p>') AS hash, strftime(last_seen_at, '%Y%m%dT%H%M%SZ') || '-' || substr(sha256('<p>' || coalesce(title, '') || '</p>'), 1, 12) || '.html' AS name FROM rental_listings",
    "page_latest": "SELECT CAST(listing_id AS VARCHAR) AS key, max(strftime(last_seen_at, '%Y%m%dT%H%M%S')) || '-' || listing_id || '.html' AS name FROM rental_listings WHERE last_seen_at IS NOT NULL GROUP BY listing_id",
    "page_kind_counts": """WITH k AS (SELECT CASE doc_id % 3 WHEN 0 THEN '<div class="content__list--item"><i class="content__list--item-price">' WHEN 1 THEN '<p class="content__article__info">g_conf.houseCode' ELSE '' END || text AS t, doc_id % 3 AS m FROM documents)
SELECT coalesce(m = 0 AND length(t) >= 1000, false) AS is_list, coalesce(m = 1 AND length(t) >= 1000, false) AS is_detail, length(coalesce(t, '')) < 50000 AS is_captcha, count(*) AS n FROM k GROUP BY ALL""",
    "page_details": f"""WITH {ONE}, p AS (SELECT listing_id AS i, 'H' || listing_id AS item_id, CASE WHEN listing_id % 7 <> 0 THEN CASE WHEN listing_id % 3 <> 0 THEN nullif({_tidy('title')}, '') ELSE nullif({_tidy("regexp_extract(title, '^([^-]*)', 1)")}, '') END END AS t, rent_price,
  {_NUM.format('area_sqm')} AS area, nullif({_tidy('orientation')}, '') AS o, nullif({_tidy('floor')}, '') AS f, longitude AS x, latitude AS y, layout, title FROM u),
q AS (SELECT i AS page_id, item_id, coalesce(t, 'card ' || i) AS title, rent_price AS rent, CASE WHEN i % 5 <> 0 THEN rent_price END AS own, CAST(area AS DOUBLE) AS area, coalesce(CASE WHEN i % 4 <> 0 THEN o END, coalesce(o, '向')) AS orientation, coalesce(CASE WHEN i % 4 <> 0 THEN f END, f) AS floor,
  CASE WHEN NOT isnan(x) AND NOT isnan(y) THEN x END AS longitude, CASE WHEN NOT isnan(x) AND NOT isnan(y) THEN y END AS latitude, '近地铁|精装' AS tags, '近地铁' AS subway,
  regexp_matches(concat_ws(' ', t, layout), '[0-9]室[0-9]厅') OR contains(concat_ws(' ', t, layout), '一居') AS laid FROM p)
SELECT * EXCLUDE (own, laid), round(coalesce(list_avg(list_filter([CASE WHEN own IS NOT NULL THEN 0.95 END, CASE WHEN area IS NOT NULL THEN 0.9 END, CASE WHEN laid THEN 0.9 END, CASE WHEN longitude IS NOT NULL THEN 0.9 END], lambda v: v IS NOT NULL)), 0) + 1e-9, 2) AS overall_confidence FROM q""",
    "api_items": f"WITH {ONE} SELECT CAST(listing_id AS VARCHAR) AS item_id, {_strip('title')} AS address, rent_price AS rent, 3 AS pages, coalesce(len(image_urls), 0) AS images, district AS district_en, longitude, latitude, CAST(floor(epoch(host_last_login_at)) AS BIGINT) AS login_s FROM u WHERE listing_id % 11 <> 0",
    "page_labels": f"WITH {ONE} SELECT CAST(listing_id AS VARCHAR) AS item_id, nullif({_tidy('deposit')}, '') AS deposit, coalesce(nullif({_tidy('floor')}, ''), 'old') AS floor, CASE WHEN listing_id % 2 = 0 THEN '个人转租' ELSE '整租' END AS kind FROM u",
    "page_enrichment": f"""WITH {ONE}, p AS (SELECT CAST(listing_id AS VARCHAR) AS item_id, listing_id % 3 <> 0 AS ld, title, {_strip('title')} AS address, rent_price, district, CAST({_NUM.format('area_sqm')} AS DOUBLE) AS area, CASE WHEN NOT isnan(longitude) THEN longitude END AS x, CASE WHEN NOT isnan(latitude) THEN latitude END AS y, deposit, floor, listing_id FROM u WHERE listing_id % 11 <> 0),
q AS (SELECT item_id, CASE WHEN ld AND title <> '' THEN title ELSE nullif(address, '') END AS title, nullif(rent_price, 0) AS rent, nullif(district, '') AS district, CASE WHEN ld THEN area END AS area, nullif(x, 0) AS longitude, nullif(y, 0) AS latitude, nullif({_tidy('deposit')}, '') AS deposit, coalesce(nullif({_tidy('floor')}, ''), 'old') AS floor,
  'CNY' AS currency, CASE WHEN listing_id % 2 = 0 THEN 'sublet' ELSE 'whole_rent' END AS listing_type FROM p)
SELECT *, round(coalesce(list_avg(list_filter([CASE WHEN rent IS NOT NULL THEN 0.95 END, CASE WHEN area IS NOT NULL THEN 0.9 END, CASE WHEN longitude IS NOT NULL AND latitude IS NOT NULL AND district IS NOT NULL THEN 0.85 END], lambda v: v IS NOT NULL)), 0) + 1e-9, 2) AS overall_confidence FROM q""",
    "csv_price_rows": "SELECT listing_id, distance_bucket, rent_price, area_sqm, coalesce(apartment_like, false) AS apartment_like, coalesce(possible_duplicate, false) AS possible_duplicate FROM price_area_rows WHERE trim(coalesce(listing_id, '')) <> ''",
    "csv_bucket_map": "SELECT listing_id, arg_max(distance_bucket, row(coalesce(computed_on, DATE '1970-01-01'), coalesce(loaded_on, DATE '1970-01-01'), coalesce(rent_price, -1), coalesce(source, ''), distance_bucket)) AS distance_bucket FROM price_area_rows WHERE distance_bucket IS NOT NULL AND trim(coalesce(listing_id, '')) <> '' GROUP BY 1",
    "missing_inputs": "SELECT layer FROM (SELECT 'of_nobody' AS layer, (SELECT count(*) FROM rental_listings WHERE source = 'nobody') AS n UNION ALL SELECT 'listings', (SELECT count(*) FROM rental_listings) UNION ALL SELECT 'rows', (SELECT count(*) FROM price_area_rows) UNION ALL SELECT 'null_days', (SELECT count(*) FROM price_area_rows WHERE loaded_on < DATE '1970-01-01')) WHERE n = 0",
    "validation_export": f"SELECT DISTINCT {_VAL}, {_REV} FROM rental_listings",
    "filter_export": f"WITH {L} SELECT CASE WHEN {_WHY} = '' THEN '是' ELSE '否' END AS accepted, {_WHY} AS reasons, {', '.join(c if c in ('rent_price', 'area_sqm') else f'coalesce({c}, {chr(39)}{chr(39)}) AS {c}' for c in _FIL)} FROM l",
    "json_points": "SELECT DISTINCT listing_id, CASE WHEN NOT isnan(longitude) THEN longitude END AS longitude, CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude, rent_price, title, 'listing' AS kind FROM rental_listings",
    "observation_fallback": "SELECT source, source_listing_id, epoch_us(max(last_seen_at)) AS observed_us, any_value(rent_price) AS rent_price, 'active' AS availability_status, CAST(date_diff('day', CAST(any_value(first_seen_at) AS DATE), CAST(max(last_seen_at) AS DATE)) AS INTEGER) AS days_on_market FROM rental_listings WHERE source IS NOT NULL AND source_listing_id IS NOT NULL GROUP BY 1, 2",
    "event_log": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL",
    "origin_from_geocode": f"WITH {ONE} SELECT CAST(listing_id AS VARCHAR) AS origin_id, coalesce(nullif(title, ''), 'origin') AS name, longitude, latitude FROM u WHERE listing_id % 5 <> 0 AND NOT isnan(longitude) AND NOT isnan(latitude)",
    "origin_from_distances": f"WITH {D} SELECT 'w1' AS origin_id, 'Office' AS name, format('Office · {{:.6f}},{{:.6f}}', CAST({LON} AS DOUBLE), CAST({LAT} AS DOUBLE)) AS signature, true AS same, false AS moved WHERE (SELECT count(*) FROM dd WHERE distance_m > 3000) > 0",
    "text_orientation": f"""WITH r AS (SELECT DISTINCT listing_id, {_strip('orientation')} AS o, {_strip('floor')} AS f, nullif({_strip("concat_ws('　 ', orientation, floor)")}, '') AS t FROM rental_listings)
SELECT listing_id, coalesce(CASE WHEN listing_id % 2 = 0 THEN nullif(o, '') END, nullif(regexp_extract(t, '^([^\\s\\p{{Z}}]*)', 1), '')) AS orientation, coalesce(CASE WHEN listing_id % 3 = 0 THEN nullif(f, '') END, CASE WHEN regexp_matches(t, '[\\s\\p{{Z}}]') THEN regexp_extract(t, '^[^\\s\\p{{Z}}]*[\\s\\p{{Z}}]+(.*)$', 1) END) AS floor FROM r""",
    "text_location": f"WITH r AS (SELECT DISTINCT listing_id, district, subdistrict, community_name, {_LOC} AS t FROM rental_listings) SELECT listing_id, " + ", ".join(f"nullif(regexp_extract(t, {_DIST}, {i}), '') AS {n}" for i, n in enumerate(("district", "subdistrict", "community"), 1)) + " FROM r",
    "text_layout_words": "WITH r AS (SELECT DISTINCT listing_id, title, layout FROM rental_listings), t AS (SELECT listing_id, concat_ws(' ', title, CASE WHEN listing_id % 9 = 0 THEN '温馨一居' ELSE translate(layout, '０１２３４５６７８９', '0123456789') END) AS t FROM r) SELECT listing_id, coalesce(nullif(regexp_extract(t, '[0-9]室[0-9]厅(?:[0-9]卫)?'), ''), CASE WHEN contains(t, '一居') THEN '一居' END) AS layout FROM t",
    "text_area_guess": f"""WITH RECURSIVE k AS (SELECT p, min(name) AS name FROM (SELECT substr(name, 1, 2) AS p, name FROM ref_subdistricts UNION ALL SELECT name, name FROM ref_subdistricts) GROUP BY 1),
v AS (SELECT DISTINCT community_name AS c, {_strip('community_name')} AS t FROM rental_listings WHERE community_name IS NOT NULL), w AS (SELECT c, t, (SELECT arg_max(name, length(p)) FROM k WHERE starts_with(v.c, p)) AS known, regexp_replace(t, '[0-9一二三四五六七八九十]+(?:弄|幢|号|栋|楼|期|村|区|座|组)', '', 'g') AS nu FROM v),
x AS (SELECT *, regexp_replace(nu, '(?:{_NAMES})$', '') AS nn FROM w),
z(c, s, k) AS (SELECT c, nn, 0 FROM x UNION ALL SELECT c, substr(s, 1, length(s) - 1), k + 1 FROM z WHERE regexp_matches(s, '(?:{_UNITS})$') AND length(trim(substr(s, 1, length(s) - 1), ' -')) >= 3),
y AS (SELECT x.*, trim((SELECT arg_max(s, k) FROM z WHERE z.c = x.c), ' -') AS rest FROM x)
SELECT c AS community_name, CASE WHEN t = '' OR regexp_matches(t, '^[0-9]') THEN NULL WHEN regexp_matches(t, '[(（]') THEN t WHEN known IS NOT NULL THEN known WHEN length(rest) >= 2 THEN rest END AS area,
CAST(CASE WHEN t = '' OR regexp_matches(t, '^[0-9]') THEN 0 WHEN regexp_matches(t, '[(（]') THEN 0.1 WHEN known IS NOT NULL THEN 0.9 WHEN length(rest) < 2 THEN 0 WHEN regexp_matches(t, '村|社区|小区') THEN 0.7 WHEN regexp_matches(t, '苑|园|庄|名邸') THEN 0.5 WHEN nn <> nu THEN 0.4 ELSE 0.3 END AS DOUBLE) AS confidence FROM y""",
    "text_translated": "SELECT n_nationkey, CASE r_name WHEN 'ASIA' THEN '亚洲' WHEN 'EUROPE' THEN '欧洲' ELSE r_name END || ' ''' || n_name || '''' AS text FROM nation JOIN region ON n_regionkey = r_regionkey",
    "text_subway": f"SELECT DISTINCT listing_id, CASE WHEN listing_id % 2 = 0 THEN coalesce(community_name, 'A') || '(2/7, ' || listing_id % 900 || 'm)' ELSE {_strip('subway_info')} END AS text FROM rental_listings",
    "text_entities": f"WITH t AS (SELECT doc_id, {_tidy("'Aé… ' || regexp_replace(text, '[<>&\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g')")} AS t FROM documents WHERE text IS NOT NULL AND length(text) < 2000) SELECT doc_id, sha256(t) AS hash, length(t) AS n FROM t",
    "url_canonical": "SELECT DISTINCT source_listing_id, CASE WHEN regexp_full_match(source_listing_id, '[0-9]+') THEN 'https://h.example/rent/' || source_listing_id END AS url FROM rental_listings",
    "display_texts": f"WITH {V} SELECT listing_id, coalesce(CAST(rent_price AS VARCHAR) || ' / month', '-') AS money, {_one('area_sqm', 'sqm')} AS area, {_one('rent_per_sqm', '/sqm')} AS unit_price, CASE WHEN distance_m >= 1000 THEN {_one('distance_m / 1000.0', 'km')} ELSE coalesce(distance_m || ' m', '-') END AS distance, CASE tier WHEN 'ready' THEN 'Ready' WHEN 'caution' THEN 'Caution' ELSE tier END AS tier_label, CASE distance_bucket WHEN 'near' THEN 'under 4 km' WHEN 'middle' THEN '4 to 8 km' END AS bucket_label, CASE value_level WHEN 'high' THEN '#10B981' WHEN 'low' THEN '#F43F5E' ELSE '#6B7280' END AS colour FROM v",
    "subdistrict_table": "WITH t AS (SELECT substr(name, 1, 2) AS prefix, name FROM ref_subdistricts UNION SELECT name, name FROM ref_subdistricts) SELECT prefix, name, row_number() OVER (ORDER BY length(prefix) DESC, name, prefix) - 1 AS position FROM t WHERE prefix <> '' AND name <> ''",
    "union_of_batches": f"WITH {L} SELECT listing_id, source, CASE WHEN source IN ('ugc_a', 'ugc_c') THEN title END AS title, CASE WHEN source IN ('ugc_b', 'ugc_d') THEN rent_price END AS rent_price FROM l",
    "distinct_links": "WITH r AS (SELECT DISTINCT listing_id, image_urls, source_url FROM rental_listings), i AS (SELECT listing_id, list_filter(list_concat([source_url], coalesce(image_urls, []), [source_url]), lambda x: x IS NOT NULL) AS ls FROM r), k AS (SELECT listing_id, list_filter(ls, lambda x, n: list_position(ls, x) = n) AS ls FROM i) SELECT listing_id, array_to_string(ls[1:8], ' ') AS links, len(ls) AS n FROM k",
    "stalest": f"WITH {L} SELECT listing_id, CAST(floor((epoch(TIMESTAMPTZ '2026-06-01 00:00:00+00') - floor(epoch(host_last_login_at))) / 86400) AS INTEGER) AS days FROM l ORDER BY days DESC NULLS LAST, listing_id LIMIT 100",
    "top_row": f"WITH {V} SELECT listing_id, value_score FROM v ORDER BY value_score DESC NULLS LAST, distance_m ASC NULLS LAST, listing_id LIMIT 1",
    "map_cards": f"WITH {CARDS} SELECT listing_id, rent_price, coalesce(strftime(seen, '%Y-%m-%d'), 'unknown') AS login_text, CASE WHEN DATE '2026-06-01' - seen < 30 THEN 'fresh' WHEN DATE '2026-06-01' - seen < 90 THEN 'warn' WHEN seen IS NOT NULL THEN 'stale' ELSE 'unknown' END AS login_class, CASE WHEN dl > 0 THEN '↑+' || dl || '  ' || pp || '→' || rp WHEN dl < 0 THEN '↓' || dl || '  ' || pp || '→' || rp ELSE 'first record' END AS price_text, CASE WHEN dl > 0 THEN 'up' WHEN dl < 0 THEN 'down' ELSE 'none' END AS price_class FROM cd",
    "map_rings": f"WITH {D}, r AS (SELECT * FROM (VALUES ('near', {float(R.edges[0])}, 0.9), ('middle', {float(R.edges[1])}, 0.75), ('far', {float(R.edges[2])}, 0.6), ('beyond', NULL, 0.45)) t(distance_bucket, radius_m, opacity)) SELECT r.distance_bucket, CAST(radius_m AS DOUBLE) AS radius_m, CAST({LON} AS DOUBLE) AS longitude, CAST({LAT} AS DOUBLE) AS latitude, CAST(opacity AS DOUBLE) AS opacity, count(dd.listing_id) AS points FROM r LEFT JOIN dd USING (distance_bucket) GROUP BY ALL",
    "good_rows": f"WITH x AS (SELECT DISTINCT listing_id, title, rent_price, last_seen_at, first_seen_at FROM rental_listings), y AS (SELECT list_filter([CASE WHEN coalesce({_strip('title')}, '') = '' THEN 'title' END, CASE WHEN last_seen_at < first_seen_at THEN 'seen_order' END, CASE WHEN rent_price < 1 THEN 'rent' END], lambda v: v IS NOT NULL) AS w FROM x) SELECT rule, count(*) AS n FROM (SELECT unnest(w) AS rule FROM y) GROUP BY 1 UNION ALL SELECT 'kept', count(*) FROM y WHERE len(w) = 0",
    "run_totals": f"WITH {L}, o AS (SELECT source, coalesce(rent_price BETWEEN {R.min_rent} AND {R.max_rent} AND district IS NOT NULL, false) AS ok FROM l) SELECT source, count(*) AS parsed, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM o GROUP BY 1",
    "overview_metrics": f"WITH RECURSIVE {G} SELECT (SELECT count(*) FROM q) AS listings, (SELECT count(DISTINCT community_name) FROM q) AS communities, (SELECT count(*) FROM q WHERE possible_duplicate) AS duplicates, (SELECT count(*) FROM q WHERE apartment_like) AS apartments, (SELECT coalesce(max(rent_price), 0) FROM q) AS highest_rent, count(DISTINCT cluster) AS clusters, coalesce(max(cluster_size), 0) AS largest, (SELECT tier FROM q GROUP BY 1 ORDER BY count(*) DESC, tier LIMIT 1) AS usual_tier FROM g",
}

_GONE = "SELECT source, source_listing_id, availability_status, rent_price, epoch_us(observed_at) AS observed_us FROM st WHERE availability_status IN ('offline', 'out_of_window')"
_ST = f"o AS (SELECT DISTINCT source, source_listing_id, observed_at, crawl_run_id, rent_price, availability_status, title FROM listing_observations WHERE observed_at IS NOT NULL), st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_listing_id ORDER BY observed_at DESC, {T}, coalesce(title, '')) AS rn FROM o) WHERE rn = 1)"
ORACLE["delisted"] = f"WITH {_ST} {_GONE}"
ORACLE["first_delisted"] = f"WITH {_ST} {_GONE} ORDER BY observed_us, source, source_listing_id LIMIT 10"
_OTHER = (PA + ", " + LV[len(C) + 2 :]).replace(str(LON), "112.4").replace(str(LAT), "30.6")
ORACLE["recompute_for_origin"] = f"WITH {_OTHER} SELECT dd.listing_id, dd.distance_m, dd.distance_bucket, pa.price_median, pa.price_good, lv.nearby_n, lv.below_nearby_median FROM dd LEFT JOIN pa USING (listing_id) LEFT JOIN lv USING (listing_id)"

_SCOPE = f"sc AS (SELECT DISTINCT source, source_listing_id FROM l WHERE rent_price BETWEEN {R.min_rent} AND {R.max_rent} AND district IS NOT NULL), ab AS (SELECT sc.*, st.availability_status AS p FROM sc LEFT JOIN st USING (source, source_listing_id) WHERE NOT EXISTS (SELECT 1 FROM listing_snapshots s WHERE s.snapshot_date = (SELECT max(snapshot_date) FROM listing_snapshots) AND s.source = sc.source AND s.source_listing_id = sc.source_listing_id))"
STREAMS_SQL = {
    "stream_price_history": LISTINGS["price_history"],
    "stream_latest_status": f"WITH {S} SELECT source, source_listing_id, epoch_us(observed_at) AS observed_us, availability_status FROM st",
    "stream_delivery": "SELECT DISTINCT source, source_listing_id, epoch_us(observed_at) AS observed_us, crawl_run_id FROM listing_observations",
    "stored_snapshots": LISTINGS["upsert_merge"],
    "stored_observations": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, source_listing_id, observed_at ORDER BY coalesce(crawl_run_id, 1073741824), coalesce(rent_price, -1), coalesce(availability_status, ''), coalesce(days_on_market, -1)) AS rn FROM listing_observations WHERE source IS NOT NULL AND source_listing_id IS NOT NULL AND observed_at IS NOT NULL)
SELECT source, source_listing_id, epoch_us(observed_at) AS observed_us, rent_price, availability_status FROM r WHERE rn = 1""",
    "stored_pages": "WITH p AS (SELECT DISTINCT listing_id % 2 = 0 AS even, strftime(last_seen_at, '%Y%m%dT%H%M%SZ') || substr(sha256(title), 1, 12) AS k FROM rental_listings WHERE title IS NOT NULL AND last_seen_at IS NOT NULL), a AS (SELECT count(DISTINCT k) AS n FROM p), e AS (SELECT count(DISTINCT k) AS n FROM p WHERE even) SELECT 'first' AS delivery, e.n AS pages FROM e UNION ALL SELECT 'second', a.n - e.n FROM a, e UNION ALL SELECT 'stored', a.n FROM a",
    "reconcile_marks": f"WITH {L}, {S}, {_SCOPE}, m AS (SELECT count(*) FILTER (p IS DISTINCT FROM 'out_of_window') AS marks, count(*) AS absent FROM ab) SELECT (SELECT count(*) FROM (SELECT DISTINCT source, source_listing_id, observed_at, crawl_run_id, rent_price, availability_status, days_on_market FROM listing_observations)) + marks AS observations, 0 AS newly_out_of_window, absent AS already_out_of_window FROM m",
}
