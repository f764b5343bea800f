"""Addresses that denote the same building, though written differently.

Addresses are parsed into components (address_parts), written in one order and one script, and joined on hierarchical
keys: city, then lane (road, kind of road, lane number), then building number. Rules for what is missing, in order:

* no building number: denotes no building;
* kind of road missing: the kind that the city has for that road and lane number;
* lane named, but its road is unknown in the city: the lane that the estate (of the address, else of the column) has,
  if the lane number agrees; else a known road of the same lane number one slip away;
* lane missing: the lane of the estate in the address, else of the estate column; an estate whose lane nobody gives
  stands for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rookery.llm import names as N
from rookery.llm.address_parts import parse
from rookery.llm.mapping import salted_join
from rookery.operators.blocks import pairs_in_groups
from rookery.session import cut

#: A road seen with this many lane numbers in a city is known there.
KNOWN_LANES = 3

_PARTS = "road string, kind string, han string, lane long, building long, estate string, own_estate string"


def estate_key(name: str, phase: str, pinyin: dict[str, str]) -> str | None:
    """One spelling for an estate in characters or pinyin, None if there is no name."""
    if not name:
        return None
    if re.search(r"[一-鿿]", name):
        stem, ending = N.split_ending(name, N.ENDINGS)
        stem = N.romanize(stem, pinyin)
    else:
        stem, ending = N.split_latin(name, N.ENDINGS)
    return f"{stem}#{ending}@{phase}" if stem else None


def parsed(df: DataFrame, id_col: str, city: str, address: str, estate: str, pinyin: dict[str, str]) -> DataFrame:
    """Components per row: ``id``, ``city``, road, kind, han, lane, building, estate (of the address), own_estate (of the column)."""
    d = df.where(F.col(id_col).isNotNull() & F.col(address).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(city, F.lit("")).alias("city"), F.col(address).alias("a"), F.col(estate).alias("e")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, c, a, e in zip(pdf["id"], pdf["city"], pdf["a"], pdf["e"]):
                p = parse(a, pinyin)
                if p.building:
                    rows.append((i, c, p.road, p.kind, p.han, p.lane, p.building, estate_key(p.estate, p.phase, pinyin), estate_key(*N.clean_estate(e), pinyin) if isinstance(e, str) else None))
            yield pd.DataFrame(rows, columns=["id", "city", "road", "kind", "han", "lane", "building", "estate", "own_estate"])

    return d.mapInPandas(run, f"id {dict(d.dtypes)['id']}, city string, {_PARTS}")


def _one_slip(a: Column, b: Column) -> Column:
    """One character missing, added or replaced, or two swapped; a direction at the end must be the same."""
    d = F.levenshtein(a, b)
    letters = lambda c: F.array_sort(F.split(c, ""))
    way = lambda c: F.regexp_extract(c, "[东西南北]$", 0)
    return ((d <= 1) | ((d == 2) & (letters(a) == letters(b)))) & (way(a) == way(b)) & (F.length(a) > 0) & (F.length(b) > 0)


def buildings(df: DataFrame, id_col: str, city: str, address: str, estate: str, pinyin: dict[str, str], known_lanes: int = KNOWN_LANES) -> DataFrame:
    """``id``, ``place``, ``building`` of every row whose address denotes a building.

    Null ids and addresses take no part, a null city is a city of its own; empty and very long addresses are parsed whole.
    Repeated rows count once; extra columns are ignored.
    """
    rows = cut(parsed(df, id_col, city, address, estate, pinyin))
    lane_of = ["city", "road", "kind", "lane"]
    lanes = rows.where("lane > 0 and road <> ''").groupBy(*lane_of).agg(F.count(F.lit(1)).alias("n"), F.max("han").alias("han"))
    lanes = cut(lanes)
    roads = lanes.where("kind <> ''").groupBy("city", "road", "kind").agg(F.count(F.lit(1)).alias("lanes"))
    graded = lanes.join(roads, ["city", "road", "kind"], "left").withColumn("known", F.coalesce(F.col("lanes") >= known_lanes, F.lit(False)))
    graded = cut(graded.select(*lane_of, "n", "han", "known"))

    # kind missing: the most frequent kind of that road and lane number
    full = graded.where("kind <> ''")
    kinds = full.groupBy("city", "road", "lane").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind2"))
    # road unknown: a known or more frequent road with the same lane number, one slip away
    odd = graded.where("not known").select("city", "lane", F.col("road").alias("r0"), F.col("kind").alias("k0"), F.col("han").alias("h0"), F.col("n").alias("n0"))
    # two names one slip apart share one of their variants with at most one character less
    variants = lambda df, h: df.withColumn("_h", F.col(h)).where(F.length("_h") > 0).withColumn("_v", F.explode(F.expr("array_distinct(transform(sequence(0, length(_h)), k -> if(k = 0, _h, concat(substring(_h, 1, k - 1), substring(_h, k + 1)))))"))).drop("_h")
    near = variants(odd, "h0").join(variants(full, "han"), ["city", "lane", "_v"]).where((F.col("road") != F.col("r0")) & ((F.col("k0") == "") | (F.col("kind") == F.col("k0"))) & (F.col("known") | (F.col("n") > F.col("n0"))) & _one_slip(F.col("h0"), F.col("han")))
    near = near.groupBy("city", F.col("r0").alias("road"), F.col("k0").alias("kind"), "lane").agg(F.max(F.struct("known", "n", "road", "kind")).alias("m"))
    fixed = graded.join(kinds, ["city", "road", "lane"], "left").join(near, lane_of, "left")
    fixed = fixed.select(
        *lane_of, "known",
        F.when((F.col("kind") == "") & F.col("kind2").isNotNull(), F.col("road")).otherwise(F.coalesce("m.road", "road")).alias("road2"),
        F.when((F.col("kind") == "") & F.col("kind2").isNotNull(), F.col("kind2")).otherwise(F.coalesce("m.kind", "kind")).alias("kind3"),
    )
    fixed = cut(fixed)
    d = salted_join(rows, fixed, lane_of)

    # an estate has one lane in a city: the one that most of its addresses give
    says = d.where("road2 is not null")
    votes = says.where("estate is not null").select("city", F.col("estate").alias("key"), "road2", "kind3", "lane", F.lit(1).alias("own"))
    votes = votes.unionByName(says.where("own_estate is not null").select("city", F.col("own_estate").alias("key"), "road2", "kind3", "lane", F.lit(0).alias("own")))
    votes = votes.groupBy("city", "key", "road2", "kind3", "lane").agg(F.sum("own").alias("own"), F.count(F.lit(1)).alias("n"))
    homes = cut(votes.groupBy("city", "key").agg(F.max(F.struct("own", "n", "road2", "kind3", "lane")).alias("h")).select("city", "key", F.struct("h.road2", "h.kind3", "h.lane").alias("h")))
    d = salted_join(d, homes.select("city", F.col("key").alias("estate"), F.col("h").alias("h1")), ["city", "estate"])
    d = salted_join(d, homes.select("city", F.col("key").alias("own_estate"), F.col("h").alias("h2")), ["city", "own_estate"])
    home = F.coalesce("h1", F.when(F.col("estate").isNull(), F.col("h2")))
    as_home = lambda h: F.concat_ws("|", F.lit("lane"), h["road2"], h["kind3"], h["lane"].cast("string"))
    typed = F.concat_ws("|", F.lit("lane"), F.col("road2"), F.col("kind3"), F.col("lane").cast("string"))
    agreed = F.coalesce(F.when(F.col("h1.lane") == F.col("lane"), F.col("h1")), F.when(F.col("h2.lane") == F.col("lane"), F.col("h2")))
    place = (
        F.when((F.col("lane") > 0) & F.col("known"), typed)
        .when((F.col("lane") > 0) & agreed.isNotNull(), as_home(agreed))
        .when(F.col("lane") > 0, F.coalesce(F.when(F.col("road2").isNotNull(), typed), F.when(home.isNotNull(), as_home(home))))
        .when(home.isNotNull(), as_home(home))
        .otherwise(F.concat(F.lit("estate|"), F.coalesce("estate", "own_estate")))
    )
    return d.select("id", F.concat_ws("|", "city", place).alias("place"), place.alias("_p"), "building").where("_p is not null").drop("_p").distinct()


def building_classes(df: DataFrame, id_col: str, city: str, address: str, estate: str, pinyin: dict[str, str]) -> DataFrame:
    """``id``, ``class`` of the building and ``links``, the other ids there: one row for each row that denotes a building."""
    b = cut(buildings(df, id_col, city, address, estate, pinyin))
    n = b.groupBy("place", "building").agg((F.count_distinct("id") - 1).alias("links"))
    return salted_join(b, n, ["place", "building"], "inner").select("id", F.concat_ws("|", "place", "building").alias("class"), "links")


def same_building(df: DataFrame, id_col: str, city: str, address: str, estate: str, pinyin: dict[str, str]) -> DataFrame:
    """Pairs ``a`` < ``b`` of different ids in the same building; a huge building is paired by blocks."""
    return pairs_in_groups(cut(buildings(df, id_col, city, address, estate, pinyin)), ["place", "building"], "id").distinct()
