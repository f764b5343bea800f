"""Percentiles of very large columns from dyadic Count-sketches.

Values are encoded as integers in order; for each binary resolution (a node is an encoded value without its last l bits)
a signed Count-sketch counts the nodes. Sketches are rows of counters, so they merge by a sum over rows, across
partitions, files and days, and deletions are additions of -1. Resolutions with no more nodes than a sketch has columns
are kept as exact counts, which is a sketch without collisions, and groups with few different values are counts alone, which
become sketches when they grow. A percentile is found by walking down the resolutions.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rookery.session import cut

#: Ranges of the logarithmic code per factor of 2: a value is off by at most 2 ** (0.5 / PER_OCTAVE), 0.0085 %, if its size is
#: between 2 ** -INNER and 2 ** INNER, and by 2 ** (0.5 / OUTER), 9 %, beyond.
PER_OCTAVE, INNER, OUTER = 4096, 63, 4
#: First codes of the sizes below, within and above; the smallest double has 2 ** -1074.
SMALL_FROM, INNER_FROM, LARGE_FROM = 1, 1 + (1075 - INNER) * OUTER, 1 + (1075 - INNER) * OUTER + 2 * INNER * PER_OCTAVE
#: Bits of a code: sign and size.
BITS = 20
DEPTH, WIDTH = 5, 2048
#: Resolutions below this one are sketched; from it up there are at most WIDTH nodes, which are counted exactly.
EXACT = BITS - 11
#: Different values up to which a group is kept as exact counts, with level COUNTS.
FEW, COUNTS = WIDTH, -1
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.99)


def encode(c: Column) -> Column:
    """Code of a number in 0 … 2 ** BITS - 1, in the order of the numbers; null, NaN and infinite values have none.

    0 is the middle, numbers away from it are coded by their logarithm, symmetrically; every double has a code.
    """
    half = 1 << (BITS - 1)  # codes of either sign
    x = c.cast("double")
    g = F.log2(F.abs(x))
    m = F.when(g < -INNER, SMALL_FROM + F.floor((g + 1075) * OUTER)).when(g < INNER, INNER_FROM + F.floor((g + INNER) * PER_OCTAVE)).otherwise(LARGE_FROM + F.floor((g - INNER) * OUTER))
    code = F.when(x == 0, F.lit(half)).when(x > 0, F.lit(half) + m).otherwise(F.lit(half) - m)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), code.cast("long"))


def decode(code: int) -> float:
    """Middle of the range of a code."""
    half = 1 << (BITS - 1)
    m = abs(code - half)
    if m == 0:
        return 0.0
    if m < INNER_FROM:
        g = (m - SMALL_FROM + 0.5) / OUTER - 1075
    elif m < LARGE_FROM:
        g = (m - INNER_FROM + 0.5) / PER_OCTAVE - INNER
    else:
        g = (m - LARGE_FROM + 0.5) / OUTER + INNER
    return math.copysign(2.0**g, code - half)


def value_error(code: int) -> float:
    """Relative rounding of a code, at most."""
    m = abs(code - (1 << (BITS - 1)))
    return 0.0 if m == 0 else 2 ** (0.5 / (PER_OCTAVE if INNER_FROM <= m < LARGE_FROM else OUTER)) - 1


def sketch(df: DataFrame, groups: list[str], columns: list[str], weight: str | None = None) -> DataFrame:
    """Counters of the sketches of ``columns`` per ``groups``: groups, ``column``, ``level``, ``row``, ``at``, ``c``.

    ``weight`` (1 if not given) may be negative, which deletes. Equal values are counted before they are hashed, so the
    work follows the distinct values; all aggregates are combined before their shuffle. Null groups are groups of their own.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), encode(F.col(c)).alias("v")) for c in columns])).alias("x")
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    d = df.select(*groups, w.alias("w"), each).select(*groups, "w", F.col("x.column").alias("column"), F.col("x.v").alias("v")).where("v is not null")
    counts = d.select(*groups, "column", F.lit(COUNTS).alias("level"), F.lit(0).alias("row"), F.col("v").cast("int").alias("at"), F.col("w").alias("c"))
    return merge(counts, groups)


def _cells(counts: DataFrame, groups: list[str]) -> DataFrame:
    """The counters of the sketches of exact counts."""
    # one hash for a level gives the columns and signs of all rows
    level = F.explode(F.sequence(F.lit(0), F.lit(EXACT))).alias("level")
    d = counts.select(*groups, "column", F.col("c").alias("w"), F.col("at").cast("long").alias("v"), level).withColumn("node", F.expr("shiftright(v, level)"))
    d = d.groupBy(*groups, "column", "level", "node").agg(F.sum("w").alias("w"))
    d = d.withColumn("h", F.when(F.col("level") < EXACT, F.xxhash64("level", "node")))
    cells = [F.struct(F.lit(r).alias("row"), F.expr(f"cast(shiftrightunsigned(h, {12 * r}) & {WIDTH - 1}L as int)").alias("at"), F.expr(f"if(shiftrightunsigned(h, {12 * r + 11}) & 1L = 0L, w, -w)").alias("c")) for r in range(DEPTH)]
    exact = F.array(F.struct(F.lit(0).alias("row"), F.col("node").cast("int").alias("at"), F.col("w").alias("c")))
    d = d.select(*groups, "column", "level", F.explode(F.when(F.col("level") < EXACT, F.array(*cells)).otherwise(exact)).alias("x"))
    return d.select(*groups, "column", "level", "x.row", "x.at", "x.c")


def _summed(counters: DataFrame, groups: list[str]) -> DataFrame:
    return counters.groupBy(*groups, "column", "level", "row", "at").agg(F.sum("c").alias("c")).where("c <> 0")


def merge(counters: DataFrame, groups: list[str]) -> DataFrame:
    """Sum of sketches over everything but ``groups``. Exact counts stay what they are while a group has few different values and
    nothing of it is sketched; else they become counters, which gives the same sums as if they had been from the start.
    """
    keys = [*groups, "column"]
    s = cut(_summed(counters, groups))
    big = s.groupBy(*keys).agg(((F.max("level") > COUNTS) | (F.count(F.lit(1)) > FEW)).alias("_big"))
    on = reduce(lambda x, k: x & F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")), keys, F.lit(True))
    s = s.alias("s").join(big.alias("b"), on).select("s.*", "b._big")
    counts = F.col("level") == COUNTS
    new = _cells(s.where(counts & F.col("_big")), groups)
    return s.where(counts & ~F.col("_big")).drop("_big").unionByName(_summed(s.where(~counts).drop("_big").unionByName(new), groups))


def percentiles(counters: DataFrame, groups: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``q``, ``value``, ``n``, ``rank_error``, ``value_error`` per group and column, from merged sketches.

    The rank of ``value`` is off by at most ``rank_error`` (a share of ``n``) with a probability of about 0.997: three times
    the deviation of the sum of the estimates on the way down, each with the variance F2 / (width * depth) of the median of
    its rows, F2 taken from the sketch; for groups kept as counts it is 0. The value itself is off by at most ``value_error``
    (relative) from rounding. One group is at most DEPTH * WIDTH * EXACT + WIDTH counters, which is what a task holds at a time. Groups whose counts are
    all deleted give no rows.
    """
    kinds = dict(counters.dtypes)
    keys = [*groups, "column"]

    def walk(t: pa.Table) -> pa.Table:
        level, row, at, c = (t[x].to_numpy() for x in ("level", "row", "at", "c"))
        found: list[tuple[float, int, int, float]] = []
        if len(level) and (level == COUNTS).all():
            order = np.argsort(at)
            below = np.cumsum(c[order])
            n = int(below[-1])
            if n > 0:
                found = [(q, int(at[order][np.searchsorted(below, max(1, math.ceil(q * n)))]), n, 0.0) for q in quantiles]
        else:
            found = _walk_down(level, row, at, c, quantiles)
        out = {k: pa.array([t[k][0].as_py()] * len(found), t.schema.field(k).type) for k in keys}
        cols = {"q": [f[0] for f in found], "value": [decode(f[1]) for f in found], "n": [f[2] for f in found], "rank_error": [f[3] for f in found], "value_error": [value_error(f[1]) for f in found]}
        return pa.table(out | {k: pa.array(v, pa.int64() if k == "n" else pa.float64()) for k, v in cols.items()})

    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return counters.select(*keys, "level", "row", "at", "c").groupBy(*keys).applyInArrow(walk, f"{fields}, q double, value double, n long, rank_error double, value_error double")


def _walk_down(level: np.ndarray, row: np.ndarray, at: np.ndarray, c: np.ndarray, quantiles: tuple[float, ...]) -> list[tuple[float, int, int, float]]:
    """(quantile, code, n, rank error) from the counters of one group."""
    top = np.zeros(WIDTH, np.int64)
    e = level == EXACT
    top[at[e]] = c[e]
    n = int(top.sum())
    if n <= 0:
        return []
    tables = np.zeros((EXACT, DEPTH, WIDTH), np.int64)
    s = level < EXACT
    tables[level[s], row[s], at[s]] = c[s]
    f2 = np.median((tables.astype(float) ** 2).sum(axis=2), axis=1)
    error = 3 * math.sqrt(float((f2 / (WIDTH * DEPTH) * math.pi / 2).sum())) / n
    below = np.cumsum(top)
    out = []
    for q in quantiles:
        rank = max(1, math.ceil(q * n))
        node = int(np.searchsorted(below, rank))
        rest = rank - (int(below[node - 1]) if node else 0)
        size = float(top[node])
        for x in range(EXACT - 1, -1, -1):
            left = node << 1
            got, other = estimate(tables[x], x, left), estimate(tables[x], x, left + 1)
            # the two halves make up the node: share the surplus between them
            got = min(max(0.0, (got + size - other) / 2), size)
            if rest <= got:
                node, size = left, got
            else:
                node, rest, size = left + 1, rest - got, size - got
        out.append((q, node, n, round(error, 6)))
    return out


def estimate(table: np.ndarray, level: int, node: int) -> float:
    """Count of a node: the median over rows of its signed counters."""
    h = spark_xxhash64(level, node)
    cells = []
    for r in range(DEPTH):
        at, sign = (h >> (12 * r)) & (WIDTH - 1), (h >> (12 * r + 11)) & 1
        cells.append(-table[r][at] if sign else table[r][at])
    return float(sorted(cells)[DEPTH // 2])


_M = (1 << 64) - 1
# Constants of the public XXH64 algorithm.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M


def _mix(h: int) -> int:
    h = ((h ^ (h >> 33)) * _P2) & _M
    h = ((h ^ (h >> 29)) * _P3) & _M
    return h ^ (h >> 32)


def spark_xxhash64(level: int, node: int) -> int:
    """The engine's xxhash64 of an int and a bigint column, as an unsigned number (each column hashes with the last as seed)."""
    h = (42 + _P5 + 4) & _M
    h = _mix((_rotl(h ^ ((level & 0xFFFFFFFF) * _P1 & _M), 23) * _P2 + _P3) & _M)
    k = _rotl(node * _P2 & _M, 31) * _P1 & _M
    h = (h + _P5 + 8) & _M
    return _mix((_rotl(h ^ k, 27) * _P1 + _P4) & _M)
