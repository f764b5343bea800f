"""Free-typed values mapped to the entries of a reference list, with the unmatched reported.

Distinct typed values are cleaned of decorations and read as sets of q-grams: syllables (so that a name in characters, in
pinyin or with a homophone is the same) and pairs of neighbouring syllables. Grams carry kind, ending and phase, so that
names that differ in them share nothing; an entry is also known without its ending. Values and entries meet in the
prefix-filtered Jaccard join; a value means the entry with the highest Jaccard similarity that reaches the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rookery.llm import names as N
from rookery.llm.set_join import jaccard_join
from rookery.session import cut

#: Jaccard similarity of q-gram sets from which a value means an entry. A name of two syllables of which one is wrong
#: has 1/3 with its entry, two different names of which half the syllables are equal have at most 1/4.
THRESHOLD = 0.3


def edits(a: list[str], b: list[str]) -> int:
    """Edit distance over tokens with swaps of neighbours (optimal string alignment)."""
    prev2, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            cur.append(v)
        prev2, prev = prev, cur
    return prev[-1]


Reading = tuple[list[str], str, str, str]  # syllables, characters, ending, phase


def estate_variants(value: str, pinyin: dict[str, str], syllables: set[str]) -> list[Reading]:
    """(syllables, characters, ending, phase) of each way to read a typed estate name."""
    out = []
    folded = N.fold(value)
    forms = [value]
    words = folded.split(" ")
    if len(words) > 1 and re.search(r"[一-鿿]", folded):
        forms += ["".join(words), " ".join(words[1:])]
    for form in dict.fromkeys(forms):
        name, phase = N.clean_estate(form)
        out += _read(name, phase, N.ENDINGS, pinyin, syllables)
    return out


# What may stand around a subdistrict's name.
_AROUND = re.compile(r"办事处$|\((?:镇区|城区|街道)\)$|^[一-鿿]{2}区(?=[一-鿿]{2})|[。.,，、]+$")


def subdistrict_variants(value: str, pinyin: dict[str, str], syllables: set[str]) -> list[Reading]:
    """As estate_variants, for a typed subdistrict name."""
    s = N.fold(value)
    s = re.sub(r"[【】\[\]]", "", s)
    if re.search(r"[一-鿿]", s):
        s = s.replace(" ", "")
    for _ in range(3):
        s = _AROUND.sub("", s)
    return _read(s, "", N.DISTRICT_ENDINGS, pinyin, syllables)


def _read(name: str, phase: str, endings: dict[str, str], pinyin: dict[str, str], syllables: set[str]) -> list[Reading]:
    if re.search(r"[一-鿿]", name):
        stem, ending = N.split_ending(name, endings)
        return [([pinyin.get(c, c) for c in stem], stem, ending, phase)] if stem else []
    stem, ending = N.split_latin(name, endings)
    out = [(N.segment(stem, syllables), "", ending, phase)] if stem else []
    if ending:  # the ending may be part of the name
        out.append((N.segment(re.sub(r"[^a-z]", "", name), syllables), "", "", phase))
    return out


def entry_readings(readings: list[Reading], syllables: set[str]) -> list[Reading]:
    """A reference name as it may be typed: with and without its ending, and as its letters are read."""
    out: dict[tuple, Reading] = {}
    for syl, han, ending, phase in readings[:1]:
        for s in (syl, N.segment("".join(syl), syllables)):
            for e in (ending, ""):
                out.setdefault((tuple(s), e), (s, han, e, phase))
    return list(out.values())


def grams_of(kind: str, reading: Reading) -> tuple[list[str], list[str]]:
    """(q-grams, syllables alone) of a reading as sets; repeated syllables are told apart, unreadable ones left out."""
    syl, _, ending, phase = reading
    space = f"{kind[0]}{phase}{ending}:"
    seen: dict[str, int] = {}
    ones = []
    for s in syl:
        if s not in N.UNKNOWN:
            seen[s] = seen.get(s, 0) + 1
            ones.append(space + (s if seen[s] == 1 else f"{s}+{seen[s]}"))
    if not ones:
        return [], []
    if ending:
        ones.append(space + "#")
    return list(dict.fromkeys(ones + [f"{space}{a}_{b}" for a, b in zip(["^", *syl], [*syl, "$"])])), ones


_READERS = {"estate": estate_variants, "subdistrict": subdistrict_variants}
_VARIANT = "kind string, value string, variant int, syl array<string>, han string, tokens array<string>, syllables array<string>"


def read_values(df: DataFrame, pinyin: dict[str, str], entries: bool = False) -> DataFrame:
    """Readings of each ``kind``, ``value``, or of entries; a value that can't be read has none. Values of any length have a handful."""
    syllables = set(pinyin.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, v in zip(pdf["kind"], pdf["value"]):
                found = _READERS[kind](v, pinyin, syllables)
                seen = set()
                for k, r in enumerate(entry_readings(found, syllables) if entries else found):
                    grams, ones = grams_of(kind, r)
                    if grams and (tuple(r[0]), *r[1:]) not in seen:
                        seen.add((tuple(r[0]), *r[1:]))
                        rows.append((kind, v, k, r[0], r[1], grams, ones))
            yield pd.DataFrame(rows, columns=["kind", "value", "variant", "syl", "han", "tokens", "syllables"])

    return df.select("kind", "value").mapInPandas(run, _VARIANT)


@F.pandas_udf(T.StructType([T.StructField("slips", T.IntegerType()), T.StructField("chars", T.IntegerType())]))
def _slips(a: pd.Series, b: pd.Series, ha: pd.Series, hb: pd.Series) -> pd.DataFrame:
    out = []
    for x, y, p, q in zip(a, b, ha, hb):
        x, y = list(x), list(y)
        out.append((edits(x, y), edits(list(p), list(q)) if p else 0))
    return pd.DataFrame(out, columns=["slips", "chars"])


def jaccard_candidates(typed: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs ``kind``, ``value``, ``variant``, ``ref_id``, ``r_variant`` whose q-gram sets are similar, with ``similarity``."""
    j = jaccard_join(typed, known, ["kind", "value", "variant"], ["ref_id", "variant"], THRESHOLD)
    return j.select(F.col("l_kind").alias("kind"), F.col("l_value").alias("value"), F.col("l_variant").alias("variant"), F.col("r_ref_id").alias("ref_id"), F.col("r_variant").alias("r_variant"), F.col("jaccard").alias("similarity"))


def map_values(values: DataFrame, ref: DataFrame, pinyin: dict[str, str], candidates: Callable[[DataFrame, DataFrame], DataFrame] = jaccard_candidates) -> DataFrame:
    """Best entries for each distinct ``kind``, ``value``: ``ref_id``, ``similarity``, ``tie`` (1 if it is the only best).

    ``ref`` has ``kind``, ``ref_id`` and ``name``. A value that is a name of the list, character by character, maps to it. Nulls and
    empty values aren't mapped. The entry with the highest similarity is best; of entries with the same one that with the
    least edit distance, by syllables and then by characters. Entries that still tie come as several rows; a value without
    an entry has no row. Of a name of which one syllable is left only the very name is an entry.
    """
    names = ref.select("kind", F.col("name").alias("value"), "ref_id")
    marked = values.where(F.col("value").isNotNull()).select("kind", "value").distinct().join(names, ["kind", "value"], "left")
    marked = cut(marked)
    typed = cut(read_values(marked.where("ref_id is null"), pinyin))
    known = cut(read_values(names.select("kind", "value").distinct(), pinyin, True).join(names, ["kind", "value"]))
    c = candidates(typed, known)
    top = F.rank().over(Window.partitionBy("kind", "value").orderBy(F.desc(F.round("similarity", 9))))  # a handful of candidates for each value
    c = c.withColumn("_r", top).where("_r = 1").drop("_r")
    t = typed.select("kind", "value", "variant", "syl", "han")
    k = known.select("kind", "ref_id", F.col("variant").alias("r_variant"), F.col("syl").alias("r_syl"), F.col("han").alias("r_han"))
    c = c.join(k, ["kind", "ref_id", "r_variant"]).join(t, ["kind", "value", "variant"]).where((F.col("similarity") > 1 - 1e-9) | (F.size("syl") >= 2))
    c = c.withColumn("e", _slips("syl", "r_syl", "han", "r_han"))
    c = c.groupBy("kind", "value", "ref_id").agg(F.max("similarity").alias("similarity"), F.min("e").alias("e"))
    best = F.rank().over(Window.partitionBy("kind", "value").orderBy("e"))
    c = c.withColumn("_r", best).where("_r = 1").withColumn("tie", F.count(F.lit(1)).over(Window.partitionBy("kind", "value")).cast("int"))
    c = c.select("kind", "value", "ref_id", "tie", "similarity")
    exact = marked.where("ref_id is not null").select("kind", "value", "ref_id", F.lit(1).alias("tie"), F.lit(1.0).alias("similarity"))
    return cut(exact.unionByName(c))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Join to a side with few rows a key when one key may hold a third of ``left``: the right side is repeated per salt.

    Rows with a null key match nothing and are spread over very many salts, so that they don't meet in a few tasks.
    """
    null = reduce(lambda x, k: x | F.col(k).isNull(), keys, F.lit(False))
    h = F.xxhash64(*left.columns)
    a = left.withColumn("_salt", F.when(null, F.pmod(h, F.lit(1 << 20))).otherwise(F.pmod(h, F.lit(salts))).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def map_rows(rows: DataFrame, ref: DataFrame, pinyin: dict[str, str], agree: tuple[str, ...] = (), candidates: Callable[[DataFrame, DataFrame], DataFrame] = jaccard_candidates) -> DataFrame:
    """``rows`` (``id``, ``kind``, ``value``, ``agree`` …) with ``ref_id`` (-1: no entry is meant), ``similarity`` and ``exact``.

    Entries that tie for a value are ranked per row by how many of the columns ``agree``, which ``rows`` and ``ref`` both
    have, are equal (earlier ones first); what still ties goes to the least ``ref_id``. For kind ``estate`` an entry whose
    ``parent`` is the row's mapped subdistrict goes first. Null ids and null values give no row.
    """
    rows = rows.where(F.col("value").isNotNull() & F.col("id").isNotNull()).select("id", "kind", "value", *agree).distinct()
    m = map_values(rows, ref, pinyin, candidates)
    info = ref.select("kind", "ref_id", F.col("name").alias("ref_name"), "parent", *[F.col(c).alias(f"_ref_{c}") for c in agree])
    j = cut(salted_join(rows, m.join(info, ["kind", "ref_id"]), ["kind", "value"]))
    home = j.where("kind = 'subdistrict' and ref_id is not null").groupBy("id").agg(F.min("ref_id").alias("home"))
    tied = j.where("tie > 1").join(home, "id", "left")
    fit = F.array(*[F.coalesce(a != b, F.lit(True)).cast("int") for a, b in [(F.col("parent"), F.col("home")), *((F.col(c), F.col(f"_ref_{c}")) for c in agree)]])
    tied = tied.groupBy("id", "kind", "value").agg(F.min(F.struct(fit, F.col("ref_id").alias("ref_id"), "ref_name", "similarity")).alias("b")).select("id", "kind", "value", "b.ref_id", "b.ref_name", "b.similarity")
    plain = j.where("tie is null or tie = 1").select("id", "kind", "value", F.coalesce("ref_id", F.lit(-1).cast("long")).alias("ref_id"), "ref_name", "similarity")
    return plain.unionByName(tied).withColumn("exact", F.coalesce(F.col("value") == F.col("ref_name"), F.lit(False))).drop("ref_name")
