"""Text functions as Column expressions; Unicode white space counts everywhere."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def clean_text(c: Column, entities: bool = True) -> Column:
    """Tags become blanks, entities characters, white space single blanks; nothing outside."""
    c = F.regexp_replace(c, "<[^>]+>", " ")
    return strip(F.regexp_replace(_unescape(c) if entities else c, r"(?U)\s+", " "))


def plain_entities(c: Column) -> Column:
    """The entities that markup itself needs, decoded by built-in functions; for arrays, where no Python can run."""
    # The entities.
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def first_int(c: Column) -> Column:
    """The first run of digits, commas aside; null if none."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(",")), "[0-9]+", 0), F.lit("")).try_cast("int")


def all_ints(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.replace(c, F.lit(",")), F.lit("[0-9]+"), 0), lambda x: x.try_cast("int"))


def price_bounds(c: Column) -> Column:
    """Struct of the least and greatest integer in a text."""
    return F.struct(F.array_min(all_ints(c)).alias("low"), F.array_max(all_ints(c)).alias("high"))


def area_sqm(c: Column) -> Column:
    """The number before a square-metre sign."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)\s*(?:㎡|m²|平米|平)", 1), F.lit("")).try_cast("double")


def layout_parts(c: Column) -> Column:
    """Struct of rooms, halls and baths written as N室M厅K卫; missing parts are null."""
    part = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("int")
    return F.struct(part("([0-9]+)[室房]").alias("rooms"), part("([0-9]+)厅").alias("halls"), part("([0-9]+)卫").alias("baths"))


def layout_text(c: Column) -> Column:
    """The layout in a text as it is written: N室M厅 with baths if named, or the word for one room; null if there is none."""
    found = F.nullif(F.regexp_extract(c, "([0-9]室[0-9]厅(?:[0-9]卫)?)", 1), F.lit(""))
    return F.coalesce(found, F.when(F.contains(c, F.lit("一居")), F.lit("一居")))


def orientation_and_floor(both: Column, orientation: Column, floor: Column) -> Column:
    """Struct of orientation and floor, each as given or else from a text that has both, cut at its first white space."""
    orientation, floor, both = (F.nullif(strip(c), F.lit("")) for c in (orientation, floor, both))
    parts = head_and_rest(both)
    return F.struct(F.coalesce(orientation, parts["head"]).alias("orientation"), F.coalesce(floor, parts["rest"]).alias("floor"))


def located(c: Column, district: str) -> Column:
    """Struct of district, subdistrict and community of a text like DISTRICTsubdistrict的community, whose district matches the
    pattern ``district``; all null if it doesn't begin with one.
    """
    got = lambda i: F.nullif(F.regexp_extract(c, rf"^({district})([^的]*)(?:的(.*))?$", i), F.lit(""))
    return F.struct(got(1).alias("district"), got(2).alias("subdistrict"), got(3).alias("community"))


def canonical_url(base: str, listing_id: Column) -> Column:
    """The URL of a listing by its id; null for ids that aren't digits."""
    return F.when(listing_id.rlike("^[0-9]+$"), F.concat(F.lit(base.rstrip("/") + "/"), listing_id))


def head_and_rest(c: Column) -> Column:
    """Struct of the text before the first run of white space and the rest; the rest is null without one."""
    parts = F.split(strip(c), r"(?U)\s+", 2)
    return F.struct(F.nullif(F.get(parts, F.lit(0)), F.lit("")).alias("head"), F.get(parts, F.lit(1)).alias("rest"))


def dashed(c: Column, n: int) -> Column:
    """Part n (from 0) of a text cut at dashes or slashes, stripped; null if missing or empty."""
    return F.nullif(strip(F.get(F.split(c, r"[-/·]"), F.lit(n))), F.lit(""))


def trailing_id(url: Column) -> Column:
    """The last path segment of a URL if it is all digits."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.nullif(F.regexp_extract(path, r"/([0-9]+)/?$", 1), F.lit(""))


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b, x) if b is not None and x is not None else None for b, x in zip(base, link)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def absolute_urls(base: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([[urljoin(b or "", x) for x in xs] for b, xs in zip(base, links)])


def iso_time(c: Column) -> Column:
    """ISO time stamp, also with Z, or a date alone; null if neither."""
    return F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def epoch_time(c: Column) -> Column:
    """Seconds since 1970 as a number or a text of digits."""
    s = c.cast("string")
    return F.when(s.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.timestamp_seconds(s.try_cast("double")))


def non_empty(*cs: Column) -> Column:
    """The first of the texts that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def subway_text(c: Column) -> Column:
    """Subway stations of a JSON list as "name(lines, Nm); …"; text that isn't such a list stays as it is."""
    stops = F.from_json(c, "array<struct<name:string,lines:array<string>,distance:double>>")
    one = lambda x: F.concat(x["name"], F.lit("("), F.concat_ws("/", x["lines"]), F.lit(", "), F.format_string("%.0f", x["distance"]), F.lit("m)"))
    text = F.concat_ws("; ", F.transform(F.filter(stops, lambda x: x["name"].isNotNull()), one))
    return F.when(F.nullif(text, F.lit("")).isNotNull(), text).otherwise(strip(c))


def translated_prefix(c: Column, names: dict[str, str]) -> Column:
    """The text with the first of ``names`` that it begins with replaced by its translation; curly quotes made plain."""
    c = F.translate(c, "‘’“”", "''\"\"")
    out = c
    for k, v in names.items():
        out = F.when(c.startswith(k), F.concat(F.lit(v), F.substr(c, F.lit(len(k) + 1)))).otherwise(out)
    return out


#: Endings that are taken off a title one after the other, and endings of which one is taken off first.
UNIT_ENDINGS, NAME_ENDINGS = "弄|幢|号|栋|楼|期|村|区|座|组|苑|园|庄|阁|轩|庭|城|都|汇|路|街|道|里", "社区|小区|新村|公寓|大厦|大楼|名邸|花园|中心|广场"


def area_guess(title: Column, known: Column | None = None) -> Column:
    """Struct of an area name and a confidence from a free title.

    Nothing for a blank title or one that begins with digits; a title with a bracket as it stands, 0.1; ``known``, the name that
    a dictionary has for it, 0.9; else what numbered units, one name ending and then unit endings leave, as long as three
    characters remain before each: 0.7 for villages and estates, 0.5 for gardens and courts, 0.4 if a name ending went, 0.3
    otherwise; nothing if less than two characters are left.
    """
    t = strip(title)
    no_units = F.regexp_replace(t, "[0-9一二三四五六七八九十]+(?:弄|幢|号|栋|楼|期|村|区|座|组)", "")
    no_name = F.regexp_replace(no_units, f"(?:{NAME_ENDINGS})$", "")
    # one unit ending after the other, while three characters remain: the shortest rest of three or more before endings only
    left = F.regexp_replace(no_name, f"^(.{{2,}}?[^ \\-])(?:{UNIT_ENDINGS})+$", "$1")
    left = F.regexp_replace(F.when(F.length(left) >= 3, left).otherwise(no_name), "^[ \\-]+|[ \\-]+$", "")
    sure = F.when(t.rlike("村|社区|小区"), 0.7).when(t.rlike("苑|园|庄|名邸"), 0.5).when(no_name != no_units, 0.4).otherwise(0.3)
    blank = t.isNull() | (t == "") | t.rlike("^[0-9]")
    bracket = t.rlike("[(（]")
    found = F.lit(None).cast("string") if known is None else known
    short = F.length(left) < 2
    name = F.when(blank, None).when(bracket, t).when(found.isNotNull(), found).when(~short, left)
    conf = F.when(blank, 0.0).when(bracket, 0.1).when(found.isNotNull(), 0.9).when(short, 0.0).otherwise(sure)
    return F.struct(name.alias("name"), conf.alias("confidence"))


def money_text(c: Column) -> Column:
    return F.coalesce(F.concat(F.floor(c).cast("long").cast("string"), F.lit(" / month")), F.lit("-"))


def one_place(c: Column, unit: str) -> Column:
    """A number with one decimal and a unit; "-" without one."""
    return F.coalesce(F.concat(F.when(c.isNotNull(), F.format_string("%.1f", c.cast("double"))), F.lit(f" {unit}")), F.lit("-"))


def distance_text(c: Column) -> Column:
    return F.when(c.isNull(), "-").when(c >= 1000, one_place(c / 1000, "km")).otherwise(F.concat(F.floor(c).cast("long").cast("string"), F.lit(" m")))


def labelled(c: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """The label of a value; ``default``, or the value itself, where it has none."""
    out = c if default is None else F.lit(default)
    for k, v in labels.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def joined_notes(notes: list[tuple[Column, str]], default: str = "") -> Column:
    """The names whose condition holds, in order, with "; " between them; ``default`` if none does."""
    text = F.concat_ws("; ", *[F.when(c, F.lit(n)) for c, n in notes])
    return F.when(text == "", F.lit(default)).otherwise(text)
