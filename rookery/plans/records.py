"""Queries of captured pages, of files, and of the smaller operators on fields, each with its SQL.

Captured pages are made of the rows of rental_listings: every page is written from the row's own texts and numbers, with the
dirt that pages have (entities, tags inside texts, broken and repeated blocks, missing parts), and read back by the parsers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rookery.functions.text import area_guess, canonical_url, clean_text, distance_text, labelled, layout_text, located, money_text, one_place, orientation_and_floor, strip, subway_text, translated_prefix
from rookery.operators import history as hist, layers, origins, store
from rookery.operators.ranks import global_order
from rookery.plans.listings import NOW, ORIGIN, R, _clusters, _distances, _history, _listings, _quality, _scored, _tie
from rookery.plans.records_sql import ORACLE
from rookery.sinks import FILTER_COLUMNS, as_json, csv_ready, validation_rows
from rookery.session import cut
from rookery.sources import last_by_key, missing_layers, pages, table, typed_rows

DISTRICT = "[一-鿿]{2}区"


def _escaped(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _number(c: Column) -> Column:
    """A finite number as text, else nothing."""
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), c.cast("decimal(18,4)").cast("string"))


def _rows(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "rental_listings", "listing_id", "title", "description", "rent_price", "area_sqm", "layout", "district", "subdistrict", "community_name", "longitude", "latitude", "image_urls", "last_seen_at", *more)


def _listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each row of rental_listings: a card, a broken and a list block of JSON-LD, a block in an array, and links."""
    r = _rows(spark, d)
    iid = F.col("listing_id").cast("string")
    ld = F.to_json(F.struct(F.lit("RealEstateListing").alias("@type"), F.col("title").alias("name"), F.struct(F.col("rent_price").cast("string").alias("price"), F.lit("cny").alias("priceCurrency")).alias("offers"), F.struct(_number(F.col("area_sqm")).alias("value")).alias("floorSize"), F.struct(F.struct(F.col("district").alias("addressRegion")).alias("x"))["x"].alias("address"), F.struct("latitude", "longitude").alias("geo"), F.col("image_urls").alias("image")))
    item = lambda suffix: F.struct(F.struct(F.concat(F.lit("https://h.example/r/"), iid, F.lit(suffix)).alias("url"), F.col("title").alias("name"), F.struct(F.concat(F.lit("¥ "), F.format_number("rent_price", 0)).alias("price")).alias("offers"), F.date_format("last_seen_at", "yyyy-MM-dd").alias("datePosted")).alias("item"))
    listed = F.to_json(F.struct(F.lit("ItemList").alias("@type"), F.array(item(""), item("/photos"), item("0/")).alias("itemListElement")))
    block = lambda c: F.concat(F.lit('<script type="application/ld+json">'), F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    images = F.transform(F.coalesce("image_urls", F.array().cast("array<string>")), lambda u: F.concat(F.lit("<A class=x HREF='"), _escaped(u), F.lit("'></a>")))
    body = F.concat_ws(
        "", F.lit("<html><head><title>\n "), _escaped(F.col("title")), F.lit('</title></head><body><div class="item" data-code="'), iid, F.lit('"><a href="/x/'), iid, F.lit('"> <b>'), _escaped(F.col("title")),
        F.lit('</b>&nbsp;</a><p class="desc">'), F.concat_ws(" / ", _escaped(F.col("layout")), F.concat(_number(F.col("area_sqm")), F.lit("㎡"))), F.lit('</p><b class="price">¥'), F.format_number("rent_price", 0), F.lit("</b></div>"),
        F.lit('<div class="item"><a>no link</a></div>'), images, F.lit("<p>"), _escaped(F.col("description")), F.lit("</p>"), block(F.lit('{"@type":"RealEstateListing", broken')), block(listed), block(F.concat(F.lit('[{"name":"no type"},'), ld, F.lit("]"))), F.lit("</body></html>"),
    )
    return r.select(F.col("listing_id").alias("page_id"), body.alias("body"), F.lit("https://h.example/list/").alias("base"))


def page_cards(spark, d):
    c = pages.html_cards(_listing_pages(spark, d), "body")
    return c.select("page_id", "position", "item_id", "href", "title", "rent", F.round("area", 4).alias("area"), F.col("layout.rooms").alias("rooms"))


def page_ld_detail(spark, d):
    p = _listing_pages(spark, d).groupBy("page_id").agg(F.max("body").alias("body"))
    return pages.ld_detail(p, "body", ["page_id"]).select("page_id", "title", "rent", "currency", F.round("area", 4).alias("area"), "district", "longitude", "latitude", F.concat_ws(" ", "images").alias("images"))


def page_ld_list(spark, d):
    return pages.ld_list_items(_listing_pages(spark, d), "body").select("page_id", "url", "item_id", "title", "rent", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"))


def page_summary(spark, d):
    return pages.page_summary(_listing_pages(spark, d), "page_id", "body", "base").select("page_id", "title", F.concat_ws(" ", "links").alias("links"))


def page_hash(spark, d):
    """Names of captured pages by time and content; the pages are short, so that SQL can write them too."""
    r = _rows(spark, d)
    body = F.concat(F.lit("<p>"), F.coalesce("title", F.lit("")), F.lit("</p>"))
    return r.select("listing_id", pages.content_hash(body).alias("hash"), pages.raw_name(F.col("last_seen_at"), body).alias("name")).distinct()


def page_latest(spark, d):
    """The latest capture of each listing among one for each delivery."""
    r = _rows(spark, d).where("last_seen_at is not null")
    p = r.select(F.concat(F.date_format("last_seen_at", "yyyyMMdd'T'HHmmss"), F.lit("-"), F.col("listing_id").cast("string"), F.lit(".html")).alias("name"), F.col("title").alias("body"))
    return pages.latest_capture(p, F.regexp_extract("name", "-([0-9]+)[.]", 1)).select("key", "name")


def page_kind_counts(spark, d):
    """What pages look like: lists, details and others, by what their texts hold and how long they are."""
    t = table(spark, d, "documents", "doc_id", "text")
    mark = F.when(F.col("doc_id") % 3 == 0, '<div class="content__list--item"><i class="content__list--item-price">').when(F.col("doc_id") % 3 == 1, '<p class="content__article__info">g_conf.houseCode').otherwise("")
    k = pages.page_kinds(F.concat(mark, "text"))
    return t.select(k.alias("k")).groupBy(F.col("k.is_list").alias("is_list"), F.col("k.is_detail").alias("is_detail"), F.col("k.is_captcha").alias("is_captcha")).agg(F.count(F.lit(1)).alias("n"))


def _detail_pages(spark: SparkSession, d: str) -> DataFrame:
    """Detail pages, which lack their title, price or places for some listings, and with labels in both forms of lists."""
    r = _rows(spark, d, "orientation", "floor").dropDuplicates(["listing_id"])
    iid = F.col("listing_id")
    lacks = lambda n: iid % n == 0
    part = lambda cond, *cs: F.when(cond, F.concat(*cs)).otherwise(F.lit(""))
    li = lambda k, v: part(v.isNotNull(), F.lit(f"<li class='x'>{k}："), _escaped(v), F.lit("</li>"))
    body = F.concat_ws(
        "", F.lit("<html><head>"), part(~lacks(7), F.lit("<title>"), _escaped(F.col("title")), F.lit("-rent</title>")), F.lit('<meta name="description" content="'), part(F.col("district").isNotNull(), F.lit("此房源位于上海"), F.col("district"), _escaped(F.coalesce("subdistrict", F.lit(""))), F.lit("的"), _escaped(F.coalesce("community_name", F.lit(""))), F.lit("，近路")), F.lit('"></head>'),
        part(~lacks(3) & ~lacks(7), F.lit('<p class="content__title"> '), _escaped(F.col("title")), F.lit("</p>")), part(~lacks(5) & F.col("rent_price").isNotNull(), F.lit('<div class="content__aside--title"> <span>'), F.format_number("rent_price", 0), F.lit("</span>元/月</div>")),
        F.lit("<ul>"), li("基本信息", F.lit("")), li("面积", F.concat(_number(F.col("area_sqm")), F.lit("㎡"))), li("朝向", F.when(~lacks(4), F.col("orientation"))), li("楼层", F.when(~lacks(4), F.col("floor"))), F.lit('<li><span class="label">朝向楼层：</span>'), F.concat_ws(" ", F.coalesce("orientation", F.lit("向")), _escaped(F.col("floor"))), F.lit("</li>"),
        F.lit('<li><span class="label">房屋类型：</span>'), _escaped(F.col("layout")), F.lit("</li></ul>"), F.lit('<p class="content__aside--tags"><i class="a">近地铁</i><i> </i><i>精装</i></p>'),
        part(~lacks(2), F.lit("<script>g_conf.houseCode = 'H"), iid.cast("string"), F.lit("';</script>")), part(_number(F.col("longitude")).isNotNull() & _number(F.col("latitude")).isNotNull(), F.lit("<script>g_conf.coord = { longitude: '"), F.col("longitude").cast("string"), F.lit("', latitude: '"), F.col("latitude").cast("string"), F.lit("' };</script>")),
    )
    return r.select(iid.alias("page_id"), body.alias("body"), F.concat(F.lit("https://h.example/zufang/H"), iid.cast("string"), F.lit(".html")).alias("url"))


def _cards(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d).dropDuplicates(["listing_id"])
    return r.select(F.concat(F.lit("H"), F.col("listing_id").cast("string")).alias("item_id"), F.lit(0).alias("position"), F.concat(F.lit("card "), F.col("listing_id").cast("string")).alias("title"), F.col("rent_price").alias("rent"), "district", "subdistrict", F.col("community_name").alias("community"))


def page_details(spark, d):
    """Detail pages with their cards where they lack something."""
    p = pages.html_detail(_detail_pages(spark, d), "body", "url", pages.DetailFormat(district=DISTRICT))
    j = pages.with_fallback(p, _cards(spark, d), "item_id")
    return j.select("page_id", "item_id", "title", "rent", F.round("area", 4).alias("area"), "orientation", "floor", "longitude", "latitude", F.concat_ws("|", "tags").alias("tags"), "subway", "overall_confidence")


def api_items(spark, d):
    """Items of API pages of one listing each."""
    p = _api_pages(spark, d)
    x = pages.api_items(p, "body")
    return x.select("item_id", "address", "rent", "pages", "images", "district_en", "longitude", "latitude", F.unix_timestamp("login_at").alias("login_s"))


def _api_pages(spark, d):
    r = _rows(spark, d, "host_last_login_at").dropDuplicates(["listing_id"])
    item = F.struct(F.col("listing_id").cast("string").alias("id"), F.concat(F.lit(" "), F.col("title"), F.lit("　")).alias("address"), F.concat(F.lit("¥"), F.format_number("rent_price", 0)).alias("rent"), "district", "latitude", "longitude", F.col("image_urls").alias("imgs"), F.unix_timestamp("host_last_login_at").cast("string").alias("loginTime"))
    page = F.to_json(F.struct(F.lit(1).alias("page"), F.lit(41).alias("total"), F.lit(20).alias("page_size"), F.array(item).alias("list")))
    return r.select("listing_id", F.when(F.col("listing_id") % 11 == 0, F.lit("{broken")).otherwise(page).alias("body"))


def _label_pages(spark, d):
    """Pages of labels in cards and in neighbouring spans; the card counts, and of repeated spans the last."""
    r = _rows(spark, d, "deposit", "floor").dropDuplicates(["listing_id"])
    span = lambda c: F.concat(F.lit("<span> "), _escaped(c), F.lit(" </span>"))
    body = F.concat(F.lit('<div class="a rounded-[8px]">'), span(F.lit("押金")), F.lit("<br>"), span(F.col("deposit")), F.lit("</div>"), span(F.lit("押金")), span(F.lit("other")), span(F.lit("楼层")), span(F.lit("old")), span(F.lit("楼层")), F.lit("\n"), span(F.col("floor")), span(F.lit("类型")), span(F.when(F.col("listing_id") % 2 == 0, "个人转租").otherwise("整租")))
    return r.select(F.col("listing_id").cast("string").alias("item_id"), body.alias("body"))


def page_labels(spark, d):
    x = pages.label_values(_label_pages(spark, d), "body")
    return x.select("item_id", F.col("labels")["押金"].alias("deposit"), F.col("labels")["楼层"].alias("floor"), F.col("labels")["类型"].alias("kind"))


def page_enrichment(spark, d):
    """API items joined with the JSON-LD and the labels of their pages, by precedence, with confidences."""
    items = pages.api_items(_api_pages(spark, d), "body").withColumnRenamed("district_en", "district")
    p = _listing_pages(spark, d).where("page_id % 3 <> 0").groupBy(F.col("page_id").cast("string").alias("item_id")).agg(F.max("body").alias("body"))
    labels = pages.label_values(_label_pages(spark, d), "body").select("item_id", "labels")
    e = pages.enrich(items, pages.ld_detail(p, "body", ["item_id"]), labels, "item_id")
    return e.select("item_id", "title", "rent", "district", F.round("area", 4).alias("area"), "longitude", "latitude", "deposit", "floor", "currency", "listing_type", "overall_confidence")


# files


def csv_price_rows(spark, d):
    """Price rows written as the lines of a CSV file, with words for flags and decimals for whole numbers, and read back typed."""
    p = table(spark, d, "price_area_rows", "listing_id", "distance_bucket", "rent_price", "area_sqm", "apartment_like", "possible_duplicate")
    p = p.withColumn("rent_price", F.concat(F.col("rent_price").cast("string"), F.lit(".0")))
    line = csv_ready(p).select(F.to_csv(F.struct(*[F.col(c) for c in p.columns]), {"emptyValue": ""}).alias("line"))
    return typed_rows(line.select(F.from_csv("line", "listing_id string, distance_bucket string, rent_price string, area_sqm string, apartment_like string, possible_duplicate string").alias("r")).select("r.*"), "listing_id string, distance_bucket string, rent_price int, area_sqm double, apartment_like boolean, possible_duplicate boolean", ("apartment_like", "possible_duplicate"), "listing_id")


def csv_bucket_map(spark, d):
    """Distance bucket by listing; of several lines of a file the last counts, lines without an id don't."""
    p = table(spark, d, "price_area_rows", "listing_id", "source", "distance_bucket", "computed_on", "loaded_on", "rent_price")
    order = [F.coalesce(F.col(c), F.lit(x)) for c, x in (("computed_on", "1970-01-01"), ("loaded_on", "1970-01-01"), ("rent_price", -1), ("source", ""), ("distance_bucket", ""))]
    return last_by_key(p.where("distance_bucket is not null"), "listing_id", order).select("listing_id", "distance_bucket")


def missing_inputs(spark, d):
    """Which layers have no rows."""
    layer = {"listings": table(spark, d, "rental_listings", "source"), "of_nobody": table(spark, d, "rental_listings", "source").where("source = 'nobody'"), "rows": table(spark, d, "price_area_rows", "source"), "null_days": table(spark, d, "price_area_rows", "loaded_on").where("loaded_on < date '1970-01-01'")}
    return spark.createDataFrame([(n,) for n in missing_layers(layer)], "layer string")


def validation_export(spark, d):
    """The sample for reviewers as it is exported: blank reviewer columns."""
    return validation_rows(table(spark, d, "rental_listings")).distinct()


def filter_export(spark, d):
    """Candidates with the reasons that speak against them, as exported."""
    x = _listings(spark, d)
    why = layers.reasons([(F.col("rent_price").isNull(), "no_rent"), (F.col("area_sqm").isNull(), "no_area"), (F.col("district").isNull(), "no_district")], "")
    x = x.withColumns({"reasons": F.concat_ws("; ", why), "accepted": F.when(F.concat_ws("", why) == "", "是").otherwise("否")})
    return csv_ready(x.select(*[c for c in FILTER_COLUMNS if c in x.columns]))


def json_points(spark, d):
    """Points of the map as JSON records; NaN becomes null. Read back, so that the writing is checked."""
    x = table(spark, d, "rental_listings", "listing_id", "longitude", "latitude", "rent_price", "title").distinct()
    j = as_json(x.withColumn("kind", F.lit("listing")))
    return j.select(F.from_json("json", "listing_id long, longitude double, latitude double, rent_price int, title string, kind string").alias("r")).select("r.*")


def observation_fallback(spark, d):
    """Observations that stand in for an empty log: one for each listing at its last sighting."""
    o = table(spark, d, "listing_observations", "source", "source_listing_id", "observed_at", "rent_price", "availability_status", "days_on_market")
    x = store.observations_or_listings(o.where("source = 'nobody'"), table(spark, d, "rental_listings").dropDuplicates(["source", "source_listing_id"]).drop("last_seen_at").join(table(spark, d, "rental_listings").groupBy("source", "source_listing_id").agg(F.max("last_seen_at").alias("last_seen_at")), ["source", "source_listing_id"]))
    return x.select("source", "source_listing_id", F.unix_micros("observed_at").alias("observed_us"), "rent_price", "availability_status", "days_on_market")


def event_log(spark, d):
    """Events as JSON lines, read back and counted by kind and day."""
    e = table(spark, d, "events", "event_id", "event_type", "ts", "value")
    line = e.select(F.to_json(F.struct("event_id", "event_type", F.unix_timestamp("ts").alias("at"), "value")).alias("line"))
    r = line.select(F.from_json("line", "event_id long, event_type string, at long, value double").alias("r")).select("r.*")
    return r.groupBy("event_type", F.date_format(F.to_date(F.timestamp_seconds("at")), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# origins


def origin_from_geocode(spark, d):
    """Origins out of geocoding answers: the first hit's place and name; answers that failed or have no place give none."""
    r = _rows(spark, d).dropDuplicates(["listing_id"])
    place = F.concat_ws(",", F.col("longitude").cast("string"), F.col("latitude").cast("string"))
    body = F.to_json(F.struct(F.when(F.col("listing_id") % 5 == 0, "0").otherwise("1").alias("status"), F.array(F.struct(F.when(~F.isnan("longitude") & ~F.isnan("latitude"), place).alias("location"), F.nullif("title", F.lit("")).alias("formatted_address"))).alias("geocodes")))
    x = origins.from_geocode(r.select("listing_id", body.alias("body")), "body", F.col("listing_id").cast("string"), F.lit("origin"))
    return x.select("origin_id", "name", "longitude", "latitude")


def origin_from_distances(spark, d):
    """The origin that a distance table was made for, from its first row that names one; and whether it is another's."""
    x = _distances(spark, d).select("listing_id", F.lit("w1").alias("origin_id"), F.lit("Office").alias("origin_name"), F.when(F.col("distance_m") > 3000, ORIGIN[0]).alias("origin_longitude"), F.when(F.col("distance_m") > 3000, ORIGIN[1]).alias("origin_latitude"))
    o = origins.from_distances(x, "listing_id")
    return o.select("origin_id", "name", origins.signature("name", "longitude", "latitude").alias("signature"), origins.same_place(F.col("longitude"), F.col("latitude"), F.lit(ORIGIN[0] + 5e-7), F.lit(ORIGIN[1])).alias("same"), origins.same_place(F.col("longitude"), F.col("latitude"), F.lit(ORIGIN[0] + 2e-6), F.lit(ORIGIN[1])).alias("moved"))


def recompute_for_origin(spark, d):
    """Quality, distances, prices and neighbours for another origin than the usual one."""
    x = origins.recompute(_quality(spark, d), 112.40, 30.60, R)
    return x.select("listing_id", "distance_m", "distance_bucket", "price_median", "price_good", "nearby_n", "below_nearby_median")


# fields


def text_orientation(spark, d):
    r = table(spark, d, "rental_listings", "listing_id", "orientation", "floor").distinct()
    both = F.concat_ws("　 ", "orientation", "floor")
    x = orientation_and_floor(both, F.when(F.col("listing_id") % 2 == 0, F.col("orientation")), F.when(F.col("listing_id") % 3 == 0, F.col("floor")))
    return r.select("listing_id", x["orientation"].alias("orientation"), x["floor"].alias("floor"))


def text_location(spark, d):
    r = table(spark, d, "rental_listings", "listing_id", "district", "subdistrict", "community_name").distinct()
    t = F.concat(F.coalesce("district", F.lit("x")), F.coalesce(F.replace("subdistrict", F.lit("的")), F.lit("")), F.when(F.col("community_name").isNotNull(), F.concat(F.lit("的"), "community_name")).otherwise(F.lit("")))
    x = located(F.regexp_replace(t, "[\n\r]", ""), DISTRICT)
    return r.select("listing_id", x["district"].alias("district"), x["subdistrict"].alias("subdistrict"), x["community"].alias("community"))


def text_layout_words(spark, d):
    r = table(spark, d, "rental_listings", "listing_id", "title", "layout").distinct()
    t = F.concat_ws(" ", "title", F.when(F.col("listing_id") % 9 == 0, "温馨一居").otherwise(F.translate("layout", "０１２３４５６７８９", "0123456789")))
    return r.select("listing_id", layout_text(t).alias("layout"))


def text_area_guess(spark, d):
    """Area and confidence of each typed community, known ones by the longest prefix of the subdistricts' names."""
    v = table(spark, d, "rental_listings", "community_name")
    subs = table(spark, d, "ref_subdistricts", "name").select(F.substring("name", 1, 2).alias("prefix"), F.col("name").alias("mapped"))
    known = store.longest_prefix(v, "community_name", subs, "prefix", "mapped")
    g = area_guess(F.col("community_name"), F.col("mapped"))
    return known.select("community_name", g["name"].alias("area"), g["confidence"].alias("confidence"))


def text_translated(spark, d):
    """Names of nations with curly quotes, begun with a region's name that is translated."""
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").join(table(spark, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", translated_prefix(F.concat("r_name", F.lit(" ‘"), "n_name", F.lit("’")), {"ASIA": "亚洲", "EUROPE": "欧洲"}).alias("text"))


def text_subway(spark, d):
    """Stations as JSON lists, or as typed text."""
    r = table(spark, d, "rental_listings", "listing_id", "subway_info", "community_name").distinct()
    stops = F.to_json(F.array(F.struct(F.coalesce("community_name", F.lit("A")).alias("name"), F.array(F.lit("2"), F.lit("7")).alias("lines"), (F.col("listing_id") % 900).cast("double").alias("distance"))))
    return r.select("listing_id", subway_text(F.when(F.col("listing_id") % 2 == 0, stops).otherwise(F.col("subway_info"))).alias("text"))


def text_entities(spark, d):
    """Texts with tags and entities, as pages have them, cleaned."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null and length(text) < 2000")
    dirty = F.concat(F.lit("<p>&#65;&eacute;&hellip;</p>&nbsp;<br/>"), _escaped(F.regexp_replace("text", "[<>&\u0000-\u001f\u007f-\u009f]", " ")))
    return t.select("doc_id", F.sha2(clean_text(dirty), 256).alias("hash"), F.length(clean_text(dirty)).alias("n"))


def url_canonical(spark, d):
    r = table(spark, d, "rental_listings", "source_listing_id").distinct()
    return r.select("source_listing_id", canonical_url("https://h.example/rent/", F.col("source_listing_id")).alias("url"))


def display_texts(spark, d):
    """Numbers and levels as they are shown."""
    s = cut(_scored(spark, d))
    return s.select(
        "listing_id", money_text(F.col("rent_price")).alias("money"), one_place(F.col("area_sqm"), "sqm").alias("area"), one_place(F.col("rent_per_sqm"), "/sqm").alias("unit_price"), distance_text(F.col("distance_m")).alias("distance"),
        labelled(F.col("tier"), {"ready": "Ready", "caution": "Caution", "blocked": "Blocked"}).alias("tier_label"), labelled(F.col("distance_bucket"), {"near": "under 4 km", "middle": "4 to 8 km"}).alias("bucket_label"), labelled(F.col("value_level"), {"high": "#10B981", "low": "#F43F5E"}, "#6B7280").alias("colour"),
    )


# lists and composites


def subdistrict_table(spark, d):
    """The dictionary of prefixes, each with its names once, in the order of its use: the longest prefix first."""
    n = table(spark, d, "ref_subdistricts", "name", "district")
    two = n.select(F.substring("name", 1, 2).alias("prefix"), "name").unionByName(n.select(F.col("name").alias("prefix"), "name")).unionByName(n.select(F.substring("name", 1, 2).alias("prefix"), "name"))
    t = layers.dictionary(two, "prefix", "name")
    return global_order(t, [-F.length("prefix"), F.col("name"), F.col("prefix")]).select("prefix", "name", F.col("_pos").alias("position"))


def union_of_batches(spark, d):
    """Batches of the sources, put together again, with the columns that only some have."""
    x = _listings(spark, d)
    sources = ["ugc_a", "ugc_b", "ugc_c", "ugc_d"]
    parts = [x.where(F.col("source") == s).select("listing_id", "source", *(["rent_price"] if i % 2 else ["title"])) for i, s in enumerate(sources)]
    rest = x.where(F.col("source").isNull() | ~F.col("source").isin(sources)).select("listing_id", "source")
    return layers.union_all([*parts, rest])


def distinct_links(spark, d):
    """Links of each listing, repeated ones once, in their order."""
    r = table(spark, d, "rental_listings", "listing_id", "image_urls", "source_url").distinct()
    links = F.array_distinct(F.filter(F.concat(F.array("source_url"), F.coalesce("image_urls", F.array().cast("array<string>")), F.array("source_url")), lambda x: x.isNotNull()))
    return r.select("listing_id", F.concat_ws(" ", F.slice(links, 1, 8)).alias("links"), F.size(links).alias("n"))


def delisted(spark, d):
    """Listings whose latest status says that they are gone, by the time of it."""
    x = hist.latest(_observations_named(spark, d), hist.KEYS, "observed_at", [*_tie(), F.coalesce("title", F.lit(""))], ["availability_status", "rent_price", "title"])
    return hist.delisted(x, "availability_status", ("offline", "out_of_window"), "observed_at").select(*hist.KEYS, "availability_status", "rent_price", F.unix_micros("observed_at").alias("observed_us"))


def _observations_named(spark, d):
    return table(spark, d, "listing_observations", *hist.KEYS, "observed_at", "crawl_run_id", "rent_price", "availability_status", "title").distinct()


def first_delisted(spark, d):
    """The ten that went first."""
    return delisted(spark, d).orderBy("observed_us", *hist.KEYS).limit(10)


def stalest(spark, d):
    """Listings by the days since their host was last seen, those never seen last."""
    now = F.lit(NOW).cast("timestamp")
    x = _listings(spark, d).withColumn("days", F.floor((F.unix_timestamp(now) - F.unix_timestamp("host_last_login_at")) / 86400).cast("int"))
    return x.orderBy(F.desc_nulls_last("days"), "listing_id").limit(100).select("listing_id", "days")


def top_row(spark, d):
    """The best candidate, and none of a table without rows."""
    s = cut(_scored(spark, d))
    order = layers.ranking(s, ["value_score"], ["distance_m"], "listing_id")
    return s.orderBy(*order).limit(1).unionByName(s.where("listing_id = 'nobody'").orderBy(*order).limit(1)).select("listing_id", "value_score")


def map_cards(spark, d):
    """Cards of the map: rent as last observed, the latest change of it, and how long the host hasn't been seen."""
    x = layers.card_enrichment(_listings(spark, d), _history(spark, d), [*_tie(), F.col("_dom")], F.lit(NOW).cast("timestamp"))
    return x.select("listing_id", "rent_price", "login_text", "login_class", "price_text", "price_class")


def map_rings(spark, d):
    """Rings around the origin at the edges of the distance buckets, and the opacity of the points of each bucket."""
    q = _distances(spark, d).groupBy("distance_bucket").agg(F.count(F.lit(1)).alias("points"))
    return layers.rings(spark, *ORIGIN, R).join(q, "distance_bucket", "left").select("distance_bucket", "radius_m", "longitude", "latitude", "opacity", F.coalesce("points", F.lit(0)).alias("points"))


def good_rows(spark, d):
    """Rows that keep all rules, and how many each rule keeps out."""
    x = table(spark, d, "rental_listings", "listing_id", "title", "rent_price", "last_seen_at", "first_seen_at").distinct()
    good, bad = store.split_by_rules(x, {"title": F.coalesce(strip(F.col("title")), F.lit("")) != "", "seen_order": F.col("last_seen_at") >= F.col("first_seen_at"), "rent": F.col("rent_price") >= 1})
    n = bad.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(good.agg(F.lit("kept").alias("rule"), F.count(F.lit(1)).alias("n")))


def run_totals(spark, d):
    """Parsed, accepted and rejected rows of each source."""
    x = _listings(spark, d).withColumn("ok", F.coalesce(F.col("rent_price").between(R.min_rent, R.max_rent) & F.col("district").isNotNull(), F.lit(False)))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("parsed"), F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


def overview_metrics(spark, d):
    """Figures of the overview: listings, communities, flags, clusters (noise being one) and the most frequent tier."""
    q = cut(_quality(spark, d))
    c = _clusters(spark, d, q)
    one = q.agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("community_name").alias("communities"), F.count_if("possible_duplicate").alias("duplicates"), F.count_if("apartment_like").alias("apartments"), F.coalesce(F.max("rent_price"), F.lit(0)).alias("highest_rent"))
    two = c.agg(F.count_distinct("cluster").alias("clusters"), F.coalesce(F.max("cluster_size"), F.lit(0)).alias("largest"))
    three = q.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("tier", F.struct(-F.col("n"), F.col("tier"))).alias("usual_tier"))
    return one.crossJoin(two).crossJoin(three)  # one row each


QUERIES = {f.__name__: f for f in (
    page_cards, page_ld_detail, page_ld_list, page_summary, page_hash, page_latest, page_kind_counts, page_details, api_items, page_labels, page_enrichment, csv_price_rows, csv_bucket_map, missing_inputs, validation_export, filter_export, json_points,
    observation_fallback, event_log, origin_from_geocode, origin_from_distances, recompute_for_origin, text_orientation, text_location, text_layout_words, text_area_guess, text_translated, text_subway, text_entities, url_canonical, display_texts,
    subdistrict_table, union_of_batches, distinct_links, delisted, first_delisted, stalest, top_row, map_cards, map_rings, good_rows, run_totals, overview_metrics,
)}

__all__ = ["ORACLE", "QUERIES"]
