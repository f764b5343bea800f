"""Records of two sources that describe the same thing, without a shared key.

Attributes become q-grams and these set bits of vectors of fixed length: syllables of a name, the number of rooms, and for
an area or a rent the ranges of relative width around it, which lie on a ring of bits, so that two numbers differ in two
bits for each range that lies between them. Pairs within a Hamming radius are found exactly by multi-index hashing: bits
are dealt to more chunks than may differ, so that some chunks of such a pair are equal, and the search is an equi-join on
hashes of chunks. It is used twice: typed names find their entry in the reference list, and records, with their place,
find records, once for each choice of fields that both have. The pairs found get a Dice score for each field from finer
vectors. The weighted sum decides, and its confidence is calibrated against the pairs that chance alone gives.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rookery.llm.mapping import THRESHOLD
from rookery.operators.blocks import with_blocks
from rookery.session import cut

#: Names: bits that a q-gram sets in a vector of two words, chunks, and the radius: one q-gram exchanged for another, or two
#: missing. Of six chunks at least two are equal, so two are looked up at once.
HASHES, NAME_CHUNKS, RADIUS = 2, 6, 4
#: Least Dice of a typed name and its entry: one wrong syllable of three and an ending has 0.75, two of five 0.67.
LEAST_NAME = 0.7
#: Largest ratio of two areas and of two rents of one home.
AREA_RATIO, RENT_RATIO = 1.04, 1.08
#: Fine ranges within such a ratio, ranges that a number sets in the fine and in the coarse vector.
STEPS, FINE, COARSE = 16, 40, 7
#: Share of each field in the score.
WEIGHTS = {"place": 0.4, "rooms": 0.2, "area": 0.2, "rent": 0.2}
#: Dice from which a field agrees; one below it counts nothing. Numbers at the largest ratio share FINE - STEPS of FINE ranges.
FLOORS = {"place": 1.0, "rooms": 1.0, "area": 1 - STEPS / FINE, "rent": 1 - STEPS / FINE}
#: Records of a place, and entries of one chunk, that are joined as one unit; more are dealt to blocks.
PLACE_ROWS = 20_000
#: Bins of the score for the calibration.
BINS = 40
#: Fields that both records of a pair have, as bits: rooms 4, area 2, rent 1; one of the three may be missing.
PATTERNS = (7, 6, 5, 3)
FIELD_BITS = {"rooms": 4, "area": 2, "rent": 1}


def chunks_of(have: int) -> int:
    """Chunks of the vectors over some fields: one more than the bits that may differ, two for each number."""
    return 1 + 2 * bin(have & (FIELD_BITS["area"] | FIELD_BITS["rent"])).count("1")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(chunk: int, chunks: int, offset: int = 0) -> int:
    """Bits of a word that belong to a chunk: every so many-th, so that neighbours on a ring go to different chunks."""
    return _signed(sum(1 << b for b in range(64) if (b + offset) % chunks == chunk))


def name_vector(tokens: str) -> Column:
    """Vector of an array of q-grams, as a struct of two words; each sets HASHES bits."""
    one = lambda k, word: f"if(pmod(shiftright(h, {k * 16}), 128) div 64 = {word}, shiftleft(1L, cast(pmod(shiftright(h, {k * 16}), 64) as int)), 0L)"
    each = lambda word: " | ".join(one(k, word) for k in range(HASHES))
    return F.expr(f"aggregate(transform({tokens}, t -> xxhash64(t)), named_struct('lo', 0L, 'hi', 0L), (a, h) -> named_struct('lo', a.lo | {each(0)}, 'hi', a.hi | {each(1)}))")


def hamming_candidates(typed: DataFrame, known: DataFrame, radius: int = RADIUS, least: float = LEAST_NAME) -> DataFrame:
    """Pairs ``kind``, ``value``, ``variant``, ``ref_id``, ``r_variant`` whose vectors of ``syllables`` differ in at most ``radius``
    bits and have a Dice similarity of at least ``least``: all of them, with ``similarity``. Values whose vector is an entry's
    have that one only.

    With NAME_CHUNKS chunks at least NAME_CHUNKS - radius are equal; every choice of so many is an index, and a pair is
    taken from the first in which it agrees. Entries of one index hash with very many typed values are dealt to blocks.
    """
    together = NAME_CHUNKS - radius
    if together < 1:
        raise ValueError("the radius must be below NAME_CHUNKS, so that some chunk is equal")
    words = [(_mask(c, NAME_CHUNKS), _mask(c, NAME_CHUNKS, 64)) for c in range(NAME_CHUNKS)]
    picks = [tuple(sum(words[c][w] for c in pick) for w in (0, 1)) for pick in combinations(range(NAME_CHUNKS), together)]

    def vectors(df: DataFrame, ids: list[str], v: str) -> DataFrame:
        return df.select("kind", *ids, name_vector("syllables").alias("_v")).select("kind", *ids, F.col("_v.lo").alias(f"{v}_lo"), F.col("_v.hi").alias(f"{v}_hi"))

    def indexed(df: DataFrame, v: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(i).alias("at"), F.xxhash64(F.lit(i), F.expr(f"{v}_lo & {lo}L"), F.expr(f"{v}_hi & {hi}L")).alias("h")) for i, (lo, hi) in enumerate(picks)])
        return df.select("*", F.explode(each).alias("c")).select(*df.columns, F.col("c.at").alias("at"), F.col("c.h").alias("h"))

    a, b = vectors(typed, ["value", "variant"], "v"), vectors(known.withColumnRenamed("variant", "r_variant"), ["ref_id", "r_variant"], "w")
    out = ["kind", "value", "variant", "ref_id", "r_variant"]
    same = cut(a.join(b, (a["kind"] == b["kind"]) & (F.col("v_lo") == F.col("w_lo")) & (F.col("v_hi") == F.col("w_hi"))).select(a["kind"], *out[1:], F.lit(1.0).alias("similarity")))
    rest = a.join(same.select("kind", "value").distinct(), ["kind", "value"], "left_anti").withColumn("_id", F.xxhash64("value", "variant"))
    left = cut(with_blocks(indexed(rest, "v"), ["kind", "h"], "_id", PLACE_ROWS).drop("_id"))
    big = left.where("_blocks > 1").select("kind", "h", F.col("_blocks").alias("_nb")).distinct()
    right = indexed(b, "w").drop("at").join(big, ["kind", "h"], "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_nb", F.lit(1)) - 1))).drop("_nb")
    ones = lambda x, y: F.bit_count(x) + F.bit_count(y)
    lo, hi = F.col("v_lo").bitwiseXOR(F.col("w_lo")), F.col("v_hi").bitwiseXOR(F.col("w_hi"))
    dice = 2 * ones(F.col("v_lo").bitwiseAND(F.col("w_lo")), F.col("v_hi").bitwiseAND(F.col("w_hi"))) / (ones(F.col("v_lo"), F.col("v_hi")) + ones(F.col("w_lo"), F.col("w_hi")))
    j = left.drop("_blocks").join(right, ["kind", "h", "_block"]).where(ones(lo, hi) <= radius)
    first = F.coalesce(*[F.when((lo.bitwiseAND(F.lit(x)) == 0) & (hi.bitwiseAND(F.lit(y)) == 0), i) for i, (x, y) in enumerate(picks)])
    j = j.where(F.col("at") == first).select(*out, dice.alias("similarity")).where(F.col("similarity") >= least)
    return same.unionByName(j)


def entry_candidates(typed: DataFrame, known: DataFrame) -> DataFrame:
    """The Hamming search for names, with an exact check of the order of syllables, which the vectors don't have."""
    j = hamming_candidates(typed, known).join(typed.select("kind", "value", "variant", "tokens"), ["kind", "value", "variant"])
    j = j.join(known.select("kind", "ref_id", F.col("variant").alias("r_variant"), F.col("tokens").alias("_t")), ["kind", "ref_id", "r_variant"])
    common = F.size(F.array_intersect("tokens", "_t"))
    return j.where(common / (F.size("tokens") + F.size("_t") - common) >= THRESHOLD).drop("tokens", "_t")


# Words for homes of one room.
ONE_ROOM = ("studio", "开间", "单间")


def rooms(layout: str) -> Column:
    """Number of rooms in a typed layout: the first number, in digits of any width or characters; null if there is none."""
    digits = f"translate(trim({layout}), '０１２３４５６７８９一二两三四五六七八九', '01234567891223456789')"
    return F.when(F.lower(F.trim(layout)).isin(*ONE_ROOM), 1).otherwise(F.expr(f"try_cast(nullif(regexp_extract({digits}, '^([0-9]+)', 1), '') as int)"))


def positive(c: str) -> Column:
    """A number above 0 and finite, else null."""
    x = F.col(c).cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)



def ring(index: str, ones: int) -> str:
    """SQL: a word in which ``ones`` neighbouring bits are set from ``index`` on, around the ring of 64 bits."""
    m, p = _signed((1 << ones) - 1), f"cast(pmod({index}, 64) as int)"
    return f"(shiftleft({m}L, {p}) | if({p} = 0, 0L, shiftrightunsigned({m}L, 64 - {p})))"


def ring128(index: str, ones: int) -> tuple[str, str]:
    """SQL: the same around a ring of 128 bits, as two words."""
    m, p = (1 << ones) - 1, f"cast(pmod({index}, 128) as int)"
    lo = f"case when {p} < 64 then shiftleft({m}L, {p}) when {p} > {128 - ones} then shiftrightunsigned({m}L, 128 - {p}) else 0L end"
    hi = f"case when {p} >= 64 then shiftleft({m}L, {p} - 64) when {p} > {64 - ones} then shiftrightunsigned({m}L, 64 - {p}) else 0L end"
    return f"({lo})", f"({hi})"


def _range(c: str, ratio: float) -> Column:
    return F.floor(F.log(c) * (STEPS / math.log(ratio))).cast("int")


def _coarse(index: str) -> str:
    return f"cast(floor({index} / {STEPS}) as int)"


def search_words(side: str = "") -> list[str]:
    """SQL of the words of a record's search vector: area (two), rent and rooms; a field that isn't compared is 0.

    Place and rooms are dense words, so records that differ in them are further apart than the radius.
    """
    a, r, o = (f"{f}{side}" for f in ("area", "rent", "rooms"))
    lo, hi = ring128(_coarse(a), COARSE)
    return [lo, hi, ring(_coarse(r), COARSE), f"xxhash64('rooms', {o})"]


_WORD_FIELD = ("area", "area", "rent", "rooms")


def _once(df: DataFrame, named: list[str]) -> DataFrame:
    """Add columns (SQL with aliases) by a generator of one row: a projection would be put into every filter that uses it, and the
    join's condition then is more code than a method may hold.
    """
    return df.select("*", F.expr(f"inline(array(struct({', '.join(named)})))"))


def agreeing_pairs(left: DataFrame, right: DataFrame, place: list[str]) -> DataFrame:
    """Pairs of ``lid`` and ``rid`` whose search vectors differ, over the fields that both have, in at most two bits for each
    number: a range between the two areas and one between the two rents, or both between either. One of the three fields may be
    missing. With ``have`` (the fields as bits) and the Dice of each field.

    Both sides have ``place``, ``rooms``, ``area`` and ``rent``; columns of the right side named ``chance`` are kept. There
    is an index for each choice of fields of either side, and in each for every chunk of the vectors. Records of a place with
    very many left records are dealt to blocks by chunk.
    """
    kept = [c for c in ("chance",) if c in right.columns]

    def coded(df: DataFrame, i: str) -> DataFrame:
        has = reduce(lambda x, f: x + F.when(F.col(f).isNotNull(), FIELD_BITS[f]).otherwise(0), FIELD_BITS, F.lit(0))
        d = df.withColumn("has", has).where(F.col("has").isin(*PATTERNS))
        return d.select(i, *place, *([c for c in kept if c in d.columns]), "has", F.xxhash64(*place).alias("p"), F.xxhash64(F.lit("2"), *place).alias("p2"), "rooms", _range("area", AREA_RATIO).alias("area"), _range("rent", RENT_RATIO).alias("rent"))

    def entries(df: DataFrame, mine: str) -> DataFrame:
        """An entry per choice of fields of the other side and per chunk; the key is a hash of all that must be equal."""
        d = df.select("*", *[F.expr(w).alias(f"_w{k}") for k, w in enumerate(search_words())])
        each = []
        for other in PATTERNS:
            for own in PATTERNS:
                have = own & other
                if bin(have).count("1") < 2:
                    continue
                m = chunks_of(have)
                for c in range(m):
                    words = [F.expr(f"{w} & {_mask(c, m)}L") for w in ("p", "p2")]
                    words += [F.expr(f"_w{k} & {_mask(c, m, 64 if k == 1 else 0)}L") for k, f in enumerate(_WORD_FIELD) if have & FIELD_BITS[f]]
                    sides = [own, other] if mine == "l" else [other, own]
                    each.append(F.when(F.col("has") == own, F.struct(F.xxhash64(F.lit(c), *map(F.lit, sides), *words).alias("key"), F.lit(c).alias("at"), F.lit(have).alias("have"))))
        e = F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("_e")
        return d.select(*[c for c in df.columns if c not in ("p2", "has", *place)], e).select("*", "_e.key", "_e.at", "_e.have").drop("_e")

    a = cut(with_blocks(coded(left, "lid"), place, "lid", PLACE_ROWS).withColumn("_hot", F.col("_blocks") > 1).drop("_block", "_blocks"))
    b = entries(coded(right, "rid"), "r").drop("at", "have")
    cool = entries(a.where("not _hot"), "l").drop("_hot").withColumn("_block", F.lit(0))
    if a.where("_hot").limit(1).count():
        hot = cut(with_blocks(entries(a.where("_hot"), "l").drop("_hot"), ["key"], "lid", PLACE_ROWS))
        big = hot.where("_blocks > 1").select("key", F.col("_blocks").alias("_nb")).distinct()
        a = cool.unionByName(hot.drop("_blocks"))
        b = b.join(big, "key", "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_nb", F.lit(1)) - 1))).drop("_nb")
    else:  # no place needs blocks, so all are block 0
        a, b = cool, b.withColumn("_block", F.lit(0))
    b = b.withColumnsRenamed({f: f"{f}_r" for f in ("p", "rooms", "area", "rent")})
    j = a.join(b, ["key", "_block"])
    on = lambda f: f"have & {FIELD_BITS[f]} <> 0"
    # numbers of different laps around a ring, more than a hundredfold apart, are no neighbours
    j = j.where("p = p_r").where(F.expr(" and ".join(f"not ({on(f)} and abs({f} - {f}_r) >= {32 * STEPS})" for f in ("area", "rent"))))
    x = [f"if({on(f)}, {u} ^ {v}, 0L) as _x{k}" for k, (f, u, v) in enumerate(zip(_WORD_FIELD, search_words(), search_words("_r")))]
    j = _once(j.select("lid", "rid", *kept, "have", "at", *FIELD_BITS, *[f"{f}_r" for f in FIELD_BITS]), x)
    per = lambda what: F.expr("case have " + " ".join(f"when {p} then {what(p)}" for p in PATTERNS) + " end")
    j = j.where(F.expr(" + ".join(f"bit_count(_x{k})" for k in range(len(x)))) < per(chunks_of))
    # rooms of a pair within the radius are equal, so its chunks differ by area and rent only
    equal = lambda c, m: " and ".join(f"_x{k} & {_mask(c, m, 64 if k == 1 else 0)}L = 0L" for k in range(3))
    first = lambda m: "case " + " ".join(f"when {equal(c, m)} then {c}" for c in range(m)) + " end"
    j = j.where(F.col("at") == per(lambda p: first(chunks_of(p))))
    fine = lambda f: f"if({on(f)}, bit_count({ring(f, FINE)} & {ring(f + '_r', FINE)}) / {FINE}.0D, null) as _d_{f}"
    j = _once(j, [f"if({on('rooms')}, cast(rooms = rooms_r as double), null) as _d_rooms", fine("area"), fine("rent")])
    return j.select("lid", "rid", *kept, "have", F.lit(1.0).alias("place"), *[F.col(f"_d_{f}").alias(f) for f in FIELD_BITS])


def least_score(have: int) -> float:
    """Score of a pair all of whose fields just agree; one field that doesn't costs more than all others can lack."""
    fields = ["place", *[f for f, b in FIELD_BITS.items() if have & b]]
    return sum(WEIGHTS[f] * FLOORS[f] for f in fields) / sum(WEIGHTS[f] for f in fields)


def scored(pairs: DataFrame) -> DataFrame:
    """Adds ``score``, the weighted Dice over the fields that both records have, and keeps the pairs that reach the least score.

    A Dice below its field's floor counts 0.
    """
    total = sum((F.when(F.col(f).isNotNull(), w).otherwise(0.0) for f, w in WEIGHTS.items()), F.lit(0.0))
    hit = sum((F.when(F.col(f) >= FLOORS[f] - 1e-9, F.col(f) * w).otherwise(0.0) for f, w in WEIGHTS.items()), F.lit(0.0))
    least = F.coalesce(*[F.when(F.col("have") == p, least_score(p)) for p in PATTERNS])
    return pairs.withColumn("score", hit / total).where(F.col("score") >= least - 1e-9)


def calibration(found: dict[tuple[int, int], int], chance: dict[tuple[int, int], int], scale: float = 1.0) -> dict[tuple[int, int], float]:
    """Confidence of a pair by fields and bin of the score: one less the share that chance alone would give, never falling.

    ``found`` counts the pairs found, ``chance`` those found when every place is exchanged for another, ``scale`` how many
    more pairs of records stand at one place than after the exchange.
    """
    out: dict[tuple[int, int], float] = {}
    for have in sorted({h for h, _ in found}):
        least = 0.0
        for b in range(BINS + 1):
            if (have, b) in found:
                # a bin alone says what its pairs are worth; where it is empty of chance pairs, half a pair is assumed
                least = max(least, 1 - min(1.0, (chance.get((have, b), 0) * scale + 0.5) / (found[have, b] + 1)))
                out[have, b] = round(least, 4)
    return out


def match_records(left: DataFrame, right: DataFrame, place: list[str]) -> DataFrame:
    """Matched pairs ``lid``, ``rid`` with ``score`` and ``confidence``.

    Both sides have ``place`` (null: no match), ``rooms``, ``area`` and ``rent`` (null: missing; two of them are needed).
    Repeated rows count once; an id with several values is paired by each and keeps its best score. Confidences are
    calibrated against the same search in places where a record can't belong: the last column of ``place`` of the right side
    is exchanged for the next one that occurs with the same others. At most 2 x 4 x (BINS + 1) + 2 counts reach the driver.
    """
    left, right = left.dropna(subset=place).distinct(), right.dropna(subset=place).distinct()
    w = Window.partitionBy(*place[:-1]).orderBy(place[-1])  # distinct places only
    spots = right.select(*place).distinct().select(*place, F.coalesce(F.lead(place[-1]).over(w), F.min(place[-1]).over(Window.partitionBy(*place[:-1]))).alias("_next"))
    moved = right.join(spots.where(F.col("_next") != F.col(place[-1])), place).drop(place[-1]).withColumnRenamed("_next", place[-1])
    both = right.withColumn("chance", F.lit(False)).unionByName(moved.withColumn("chance", F.lit(True)))
    pairs = cut(scored(agreeing_pairs(left, both, place)).select("lid", "rid", "chance", "have", "score"))
    bin_of = F.floor(F.col("score") * BINS + 1e-9).cast("int")
    counts = pairs.groupBy("chance", "have", bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    per = lambda df, *c: df.groupBy(*place, *c).agg(F.count(F.lit(1)).alias(f"n{len(c)}"))
    chances = {r["chance"]: r["n"] for r in per(left).join(per(both, "chance"), place).groupBy("chance").agg(F.sum(F.col("n0") * F.col("n1")).alias("n")).collect()}
    scale = chances.get(False, 0) / max(1, chances.get(True, 0))
    by = calibration(*({(r["have"], r["b"]): r["n"] for r in counts if r["chance"] == side} for side in (False, True)), scale)
    pairs = pairs.where("not chance")
    if not by:
        return pairs.select("lid", "rid", "score", F.lit(None).cast("double").alias("confidence"))
    lookup = F.create_map(*[F.lit(x) for (h, b), v in by.items() for x in (h * 100 + b, v)])
    return pairs.groupBy("lid", "rid").agg(F.max("score").alias("score"), F.max(lookup[F.col("have") * 100 + bin_of]).alias("confidence"))
