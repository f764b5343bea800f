"""Listings out of captured pages: JSON API envelopes, JSON-LD blocks, repeated HTML cards, page summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rookery.functions.text import (
    _unescape, absolute_urls, area_sqm, clean_text, epoch_time, first_int, iso_time, layout_parts, layout_text, located, non_empty, orientation_and_floor, plain_entities, strip, subway_text, trailing_id,
)
from rookery.session import cut

API = "struct<page:int,total:int,page_size:int,list:array<struct<id:string,address:string,rent:string,district:string,latitude:double,longitude:double,imgs:array<string>,tags:array<string>,loginTime:string>>>"
LD_ITEM = "struct<url:string,name:string,image:string,datePosted:string,offers:struct<price:string>>"
LD = (
    "struct<`@type`:string,name:string,description:string,datePosted:string,numberOfRooms:string,numberOfBathroomsTotal:string,floorSize:struct<value:string>,geo:struct<latitude:double,longitude:double>,"
    "offers:struct<price:string,priceCurrency:string>,address:struct<addressLocality:string,addressRegion:string,streetAddress:string>,amenityFeature:array<struct<name:string>>,image:string,"
    f"itemListElement:array<struct<item:{LD_ITEM}>>>"
)


def read_captured(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """``name``, ``body`` of captured files, each read whole."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return d.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("body"))


def latest_capture(df: DataFrame, key: Column) -> DataFrame:
    """Per ``key`` the body of the capture whose name sorts last (names begin with a time stamp)."""
    return df.withColumn("key", key).groupBy("key").agg(F.max_by("body", "name").alias("body"), F.max("name").alias("name"))


def api_items(df: DataFrame, body: str) -> DataFrame:
    """One row per item of JSON API pages; bodies that aren't such pages give none."""
    d = df.withColumn("_p", F.from_json(body, API)).select("*", F.explode("_p.list").alias("_i"))
    return d.select(
        *df.columns, F.col("_p.page").alias("page"), F.ceil(F.try_divide(F.col("_p.total"), F.nullif(F.col("_p.page_size"), F.lit(0)))).cast("int").alias("pages"),
        F.col("_i.id").alias("item_id"), strip(F.col("_i.address")).alias("address"), first_int(F.col("_i.rent")).alias("rent"), F.col("_i.district").alias("district_en"),
        F.col("_i.latitude").alias("latitude"), F.col("_i.longitude").alias("longitude"), F.size(F.coalesce("_i.imgs", F.array())).alias("images"), epoch_time(F.col("_i.loginTime")).alias("login_at"),
    )


def ld_blocks(df: DataFrame, body: str) -> DataFrame:
    """Rows with ``ld``, one per object of the JSON-LD blocks, alone or in an array, in order of ``block``; broken blocks and
    objects without a type don't match. Entities in a block are decoded.
    """
    blocks = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    d = df.select("*", F.posexplode(blocks).alias("_b", "_j")).withColumn("_j", _unescape(F.trim("_j")))
    each = F.when(F.col("_j").startswith("["), F.from_json("_j", f"array<{LD}>")).otherwise(F.array(F.from_json("_j", LD)))
    d = d.select("*", F.posexplode(each).alias("_i", "ld")).where("ld is not null and ld.`@type` is not null")
    return d.withColumn("block", F.struct("_b", "_i")).drop("_j", "_b", "_i")


def ld_list_items(df: DataFrame, body: str) -> DataFrame:
    """Listings of JSON-LD item lists."""
    d = ld_blocks(df, body).where("ld.`@type` = 'ItemList'").select(*df.columns, F.explode("ld.itemListElement.item").alias("i"))
    return d.select(*df.columns, F.col("i.url").alias("url"), trailing_id(F.col("i.url")).alias("item_id"), strip(F.col("i.name")).alias("title"), first_int(F.col("i.offers.price")).alias("rent"), iso_time(F.col("i.datePosted")).alias("posted_at"))


def ld_detail(df: DataFrame, body: str, key: list[str]) -> DataFrame:
    """Per page the fields of its first JSON-LD real estate listing; what it doesn't say is null, lists are then empty. Degrees
    are as the page writes them, NaN too.
    """
    d = ld_blocks(df, body).where("ld.`@type` = 'RealEstateListing'").groupBy(*key).agg(F.min_by("ld", "block").alias("d"))
    image = F.when(F.col("d.image").startswith("["), F.from_json("d.image", "array<string>")).when(F.col("d.image").isNotNull(), F.array("d.image"))
    names = F.filter(F.transform("d.amenityFeature", lambda a: F.nullif(a["name"], F.lit(""))), lambda n: n.isNotNull())
    empty = F.array().cast("array<string>")
    return d.select(
        *key, F.col("d.name").alias("title"), F.col("d.description").alias("description"), first_int(F.col("d.offers.price")).alias("rent"), F.upper("d.offers.priceCurrency").alias("currency"),
        F.col("d.floorSize.value").try_cast("double").alias("area"), F.col("d.geo.longitude").alias("longitude"), F.col("d.geo.latitude").alias("latitude"), iso_time(F.col("d.datePosted")).alias("posted_at"),
        F.col("d.address.addressLocality").alias("city"), F.col("d.address.addressRegion").alias("district"), F.col("d.address.streetAddress").alias("street"),
        F.col("d.numberOfRooms").try_cast("double").cast("int").alias("rooms"), F.col("d.numberOfBathroomsTotal").try_cast("double").cast("int").alias("baths"), F.coalesce(names, empty).alias("features"), F.coalesce(image, empty).alias("images"),
    )


def html_cards(df: DataFrame, body: str, card: str = r'(?s)<div class="item"[^>]*>.*?</div>') -> DataFrame:
    """One row per repeated card: position, code, link, title, description parts, price; cards without link or title are dropped."""
    d = df.select("*", F.posexplode(F.regexp_extract_all(F.col(body), F.lit(card), 0)).alias("position", "c"))
    got = lambda p: F.nullif(F.regexp_extract("c", p, 1), F.lit(""))
    text = clean_text(got(r'(?s)class="desc"[^>]*>(.*?)</p>'), entities=False)
    d = d.withColumns({"code": got(r'data-code="([^"]+)"'), "href": got(r'href="([^"]+)"'), "title": F.nullif(clean_text(got(r"(?s)<a [^>]*>(.*?)</a>")), F.lit("")), "_t": text, "rent": first_int(got(r'class="price"[^>]*>([^<]*)'))})
    return d.where("href is not null and title is not null").select(*df.columns, "position", non_empty(F.col("code"), trailing_id(F.col("href"))).alias("item_id"), "href", "title", "rent", area_sqm(F.col("_t")).alias("area"), layout_parts(F.col("_t")).alias("layout"))


def _last_wins(entries: Column) -> Column:
    """A map of an array of structs ``k``, ``v``; of a repeated key the last entry counts, blank ones don't."""
    said = F.filter(entries, lambda x: (F.coalesce(x["k"], F.lit("")) != "") & (F.coalesce(x["v"], F.lit("")) != ""))
    return F.map_from_entries(F.filter(said, lambda x, i: ~F.exists(F.slice(said, i + 2, F.size(said)), lambda y: y["k"] == x["k"])))


def _plain(c: Column) -> Column:
    """A piece of markup as text, by built-in functions."""
    return strip(F.regexp_replace(plain_entities(F.regexp_replace(c, "<[^>]+>", " ")), r"(?U)\s+", " "))


def label_values(df: DataFrame, body: str, card: str = "rounded") -> DataFrame:
    """Map ``labels`` of label to value: pairs of neighbouring spans, and before them cards (divisions of a class with ``card``), in
    which the last span is the value of all others. A repeated label keeps its last value.
    """
    pair = r"(?s)<span[^>]*>([^<]*)</span>\s*<span[^>]*>([^<]*)</span>"
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(body), F.lit(pair), 1).alias("k"), F.regexp_extract_all(F.col(body), F.lit(pair), 2).alias("v"))
    pairs = F.transform(pairs, lambda x: F.struct(_plain(x["k"]).alias("k"), _plain(x["v"]).alias("v")))
    cards = F.regexp_extract_all(F.col(body), F.lit(rf'(?s)<div[^>]*class="[^"]*{card}[^"]*"[^>]*>(.*?)</div>'), 1)
    spans = F.transform(cards, lambda c: F.transform(F.regexp_extract_all(c, F.lit("(?s)<span[^>]*>([^<]*)</span>"), 1), _plain))
    inside = F.flatten(F.transform(F.filter(spans, lambda s: F.size(s) > 1), lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda k: F.struct(k.alias("k"), F.element_at(s, -1).alias("v")))))
    return df.withColumn("labels", F.map_concat(F.map_filter(_last_wins(pairs), lambda k, v: ~F.array_contains(F.transform(inside, lambda x: x["k"]), k)), _last_wins(inside)))


@dataclass(frozen=True)
class DetailFormat:
    """Fixed values of a detail page: classes of its elements, variables of its script, labels of its list, and its sentence."""

    title: str = "content__title"
    price: str = "content__aside--title"
    tags: str = "content__aside--tags"
    script: str = "g_conf"
    code: str = "houseCode"
    community: str = "name"
    subdistrict: str = "houseConditionName"
    area_label: str = "面积"
    type_label: str = "房屋类型"
    orientation_label: str = "朝向"
    floor_label: str = "楼层"
    both_label: str = "朝向楼层"
    available_label: str = "入住"
    near_subway: str = "近地铁"
    sentence: str = "此房源位于上海"
    url_id: str = "/(?:zufang|apartment)/([^/.]+)"
    district: str = "浦东|徐汇|普陀|静安|长宁|黄浦|闵行|虹口|杨浦|宝山|嘉定|松江|青浦"


def html_detail(df: DataFrame, body: str, url: str, fmt: DetailFormat = DetailFormat()) -> DataFrame:
    """The listing of each detail page: columns of ``df`` and ``item_id``, ``title``, ``description``, ``rent``, ``area``, ``layout``,
    ``orientation``, ``floor``, ``district``, ``subdistrict``, ``community``, ``longitude``, ``latitude``, ``available_from``, ``subway``,
    ``tags`` and the confidences of price, area, layout and location with their mean. What a page doesn't say is null.
    """
    b = F.col(body)
    got = lambda p, i=1: F.nullif(F.regexp_extract(b, p, i), F.lit(""))
    of_class = lambda cls: rf'(?s)<(\w+)[^>]*class="{cls}"[^>]*>(.*?)</\1>'
    variable = lambda name: got(rf"{fmt.script}\.{name}\s*=\s*'([^']*)'")
    items = F.regexp_extract_all(b, F.lit("(?s)<li[^>]*>(.*?)</li>"), 1)
    pairs = F.transform(F.filter(F.transform(items, _plain), lambda t: F.contains(t, F.lit("："))), lambda t: F.struct(strip(F.substring_index(t, "：", 1)).alias("k"), strip(F.regexp_replace(t, "^[^：]*：", "")).alias("v")))
    d = df.withColumns({
        "_l": _last_wins(pairs), "_t": non_empty(clean_text(got(of_class(fmt.title), 2)), clean_text(F.regexp_extract(got("(?s)<title>(.*?)</title>"), "^([^-]*)", 1))),
        "description": clean_text(got(r'(?s)<meta\s+name="description"\s+content="([^"]*)"')), "_c": clean_text(variable(fmt.community)), "_s": clean_text(variable(fmt.subdistrict)),
    })
    place = located(F.nullif(F.regexp_extract("description", rf"{fmt.sentence}([^,，]+)", 1), F.lit("")), fmt.district)
    label = lambda name: F.col("_l")[name]
    of = orientation_and_floor(label(fmt.both_label), label(fmt.orientation_label), label(fmt.floor_label))
    stops = got(rf"(?s){fmt.script}\.subway\s*=\s*(\[.*?\])\s*;")
    coord = lambda c: got(rf"(?s){fmt.script}\.coord\s*=\s*\{{[^}}]*{c}:\s*'([^']+)'").try_cast("double")
    tags = F.filter(F.transform(F.regexp_extract_all(F.coalesce(got(of_class(fmt.tags), 2), F.lit("")), F.lit("(?s)<i[^>]*>(.*?)</i>"), 1), _plain), lambda t: t != "")
    d = d.withColumns({
        "item_id": non_empty(variable(fmt.code), F.regexp_extract(F.col(url), fmt.url_id, 1)), "title": F.col("_t"), "rent": first_int(F.regexp_extract(got(of_class(fmt.price), 2), "(?s)<span>([0-9,]+)</span>", 1)),
        "area": area_sqm(non_empty(label(fmt.area_label), label(fmt.type_label))), "layout": layout_text(F.concat_ws(" ", "_t", label(fmt.type_label))), "_of": of, "_p": place,
        "longitude": coord("longitude"), "latitude": coord("latitude"), "available_from": label(fmt.available_label),
        "subway": F.when(stops.isNotNull(), F.when(F.from_json(stops, "array<struct<name:string>>").isNull(), fmt.near_subway).otherwise(F.nullif(subway_text(stops), stops))).otherwise(F.when(F.contains(b, F.lit(fmt.near_subway)), fmt.near_subway)), "tags": tags,
    })
    d = d.withColumns({"orientation": F.col("_of.orientation"), "floor": F.col("_of.floor"), "district": F.col("_p.district"), "subdistrict": non_empty(F.col("_s"), F.col("_p.subdistrict")), "community": non_empty(F.col("_c"), F.col("_p.community"))})
    return confidences(d.drop("_l", "_t", "_c", "_s", "_of", "_p"), F.col("longitude").isNotNull() & F.col("latitude").isNotNull(), 0.9)


def confidences(df: DataFrame, located_: Column, sure: float) -> DataFrame:
    """Adds the confidences of ``rent``, ``area``, ``layout`` and of the place, each fixed where there is a value, and their mean, 2 places."""
    d = df.withColumns({"price_confidence": F.when(F.col("rent").isNotNull(), 0.95).otherwise(0.0), "area_confidence": F.when(F.col("area").isNotNull(), 0.9).otherwise(0.0), "layout_confidence": F.when(F.col("layout").isNotNull(), 0.9).otherwise(0.0), "location_confidence": F.when(F.coalesce(located_, F.lit(False)), sure).otherwise(0.0)})
    return d.withColumn("overall_confidence", F.round(overall_confidence([F.col(f"{c}_confidence") for c in ("price", "area", "layout", "location")]), 2))


def with_fallback(details: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Details, with what they lack of title, rent, district, subdistrict and community taken from the card of the same ``key``.

    Details that have no title, nor their card, aren't listings and go; the card with the least position counts.
    """
    fields = [c for c in ("title", "rent", "district", "subdistrict", "community") if c in cards.columns and c in details.columns]
    first = cards.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*fields), "position").alias("_card"))
    d = details.join(first, key, "left")
    return d.withColumns({c: F.coalesce(F.col(c), F.col(f"_card.{c}")) for c in fields}).drop("_card").where("title is not null")


def enrich(items: DataFrame, ld: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """API items with their detail pages: JSON-LD before labels before the item, and the confidences.

    ``items`` has ``address``, ``rent``, ``district``, ``longitude``, ``latitude``; ``ld`` comes from ``ld_detail``, ``labels`` has a map
    ``labels``. Items without a page stay. Empty texts, 0 and NaN say nothing.
    """
    finite = lambda c: F.when(~F.isnan(c), F.col(c))
    x, y = ld.select(key, *[F.col(c).alias(f"_ld_{c}") for c in ld.columns if c != key]), labels.select(key, "labels")
    j = items.join(x, key, "left").join(y, key, "left")
    fields = prefer({"title": [F.col("_ld_title"), F.col("address")], "rent": [F.col("_ld_rent"), F.col("rent")], "district": [F.col("_ld_district"), F.col("district")], "community": [F.col("_ld_street"), F.col("_ld_title")], "longitude": [finite("_ld_longitude"), finite("longitude")], "latitude": [finite("_ld_latitude"), finite("latitude")]})
    baths = F.coalesce("_ld_baths", F.lit(1))
    built = F.when(F.col("_ld_rooms") > 0, F.concat(F.col("_ld_rooms").cast("string"), F.lit("室"), F.when(baths > 0, F.concat(F.lit("0厅"), baths.cast("string"), F.lit("卫"))).otherwise(F.lit(""))))
    label = lambda n: F.nullif(F.col("labels")[n], F.lit(""))
    kind = label("类型")
    listing_type = F.when(F.contains(kind, F.lit("合租")), "shared_rent").when(F.contains(kind, F.lit("转租")), "sublet").otherwise("whole_rent")
    d = j.select(key, *fields, F.col("_ld_city").alias("city"), F.col("_ld_description").alias("description"), F.col("_ld_area").alias("area"), F.coalesce(label("房间"), built).alias("layout"), label("押金").alias("deposit"), label("地铁").alias("subway"), label("楼层").alias("floor"), F.coalesce("_ld_currency", F.lit("CNY")).alias("currency"), listing_type.alias("listing_type"))
    return confidences(d, F.col("longitude").isNotNull() & F.col("latitude").isNotNull() & F.col("district").isNotNull(), 0.85)


def page_kinds(c: Column, shortest: int = 1000, captcha: int = 50_000) -> Column:
    """Struct of what a captured page seems to be: a list of cards, a detail page, a captcha (shorter than any real page)."""
    long = F.coalesce(F.length(c) >= shortest, F.lit(False))
    has = lambda t: F.coalesce(F.contains(c, F.lit(t)), F.lit(False))
    return F.struct((long & has("content__list--item") & has("content__list--item-price")).alias("is_list"), (long & has("content__article__info") & has("g_conf.houseCode")).alias("is_detail"), (F.length(F.coalesce(c, F.lit(""))) < captcha).alias("is_captcha"))


def page_summary(df: DataFrame, key: str, body: str, base: str, most: int = 20) -> DataFrame:
    """``key``, title, the first ``most`` distinct absolute links in order, and the size in bytes of each page."""
    b = F.coalesce(F.col(body), F.lit(""))
    href = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    links = F.transform(F.arrays_zip(*[F.regexp_extract_all(b, F.lit(href), i).alias(f"g{i}") for i in (1, 2, 3)]), lambda x: plain_entities(F.concat(x["g1"], x["g2"], x["g3"])))
    d = df.select(F.col(key).alias("k"), F.nullif(clean_text(F.regexp_extract(b, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"), F.coalesce(F.col(base), F.lit("")).alias("u"), F.filter(links, lambda x: x != "").alias("l"), F.octet_length(b).cast("long").alias("bytes"))
    return d.select(F.col("k").alias(key), "title", F.slice(F.array_distinct(absolute_urls("u", "l")), 1, most).alias("links"), "bytes")


def prefer(fields: dict[str, list[Column]]) -> list[Column]:
    """For each field the first source that says something (0 and empty texts say nothing)."""
    def said(c: Column) -> Column:
        return F.when(~c.cast("string").isin("", "0", "0.0"), c)

    return [F.coalesce(*[said(c) for c in cs]).alias(n) for n, cs in fields.items()]


def overall_confidence(parts: list[Column]) -> Column:
    """Mean of the positive confidences, 4 places; 0 if none."""
    pos = F.filter(F.array(*[F.coalesce(p, F.lit(0.0)) for p in parts]), lambda x: x > 0)
    return F.round(F.coalesce(F.try_divide(F.aggregate(pos, F.lit(0.0), lambda a, x: a + x), F.size(pos)), F.lit(0.0)), 4)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def raw_name(fetched_at: Column, body: Column, ending: str = ".html") -> Column:
    """Name of a captured page by its time and content."""
    return F.concat(F.date_format(fetched_at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(content_hash(body), 1, 12), F.lit(ending))


def save_captured(df: DataFrame, body: str, fetched_at: str, folder: str) -> DataFrame:
    """Append pages to a catalog under ``folder``, named by time and content; what it holds already isn't written again.

    Returns the pages that were written: ``name``, ``sha256``, ``body``.
    """
    spark = df.sparkSession
    new = df.where(F.col(body).isNotNull()).select(raw_name(F.col(fetched_at), F.col(body)).alias("name"), content_hash(F.col(body)).alias("sha256"), F.col(body).alias("body")).dropDuplicates(["name"])
    try:
        new = new.join(spark.read.parquet(folder).select("name"), "name", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new = cut(new)  # what is compared with the catalog must not change by writing it
    new.write.mode("append").parquet(folder)
    return new
