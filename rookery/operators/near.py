"""Points near other points, and regions that contain points: dual-tree joins.

The tree is an octree over the points' positions on the sphere in metres (x, y, z), so that neither the poles nor
the 180th meridian are special. A node is a cell with the exact bounding box and the count of its points. The join
walks pairs of nodes level by level as DataFrames:

* pairs of top-level cells that don't touch are further apart than the radius and never made;
* a pair whose boxes are further apart than the radius is discarded;
* a pair whose boxes lie wholly within the radius is accepted, and its point pairs need no distance;
* a pair of small nodes is a leaf pair, whose point pairs are measured;
* any other pair is replaced by the pairs of its children.

Regions and points are joined the same way on a quadtree of degrees: a region's bounding box against cells of points, which
are discarded, accepted as a whole where no edge of the region meets the cell, refined, or tested point by point.

Accepted and leaf pairs are cut into blocks of bounded size, so that a place that holds a third of all points is
spread over many tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rookery.functions.geo import EARTH_MEAN_M, haversine_m, usable
from rookery.operators.blocks import with_blocks
from rookery.session import cut

LEAF_POINTS = 64
FANOUT = 4
LEVELS = 4
SLACK_M = 1e-5
AXES = ("x", "y", "z")


def _cell(axis: str, level: int) -> str:
    return f"{axis}{level}"


def _box() -> list[Column]:
    out = [F.sum("n").alias("n")]
    for a in AXES:
        out += [F.min(f"lo_{a}").alias(f"lo_{a}"), F.max(f"hi_{a}").alias(f"hi_{a}")]
    return out


def _renamed(df: DataFrame, side: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else f"{side}_{c}") for c in df.columns])


def _gap2() -> Column:
    """Square of the least distance between the boxes of a pair."""
    return reduce(lambda s, a: s + F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo_{a}") - F.col(f"b_hi_{a}"), F.col(f"b_lo_{a}") - F.col(f"a_hi_{a}")), 2), AXES, F.lit(0.0))


def _span2() -> Column:
    """Square of the greatest distance between the boxes of a pair."""
    return reduce(lambda s, a: s + F.pow(F.greatest(F.col(f"a_hi_{a}") - F.col(f"b_lo_{a}"), F.col(f"b_hi_{a}") - F.col(f"a_lo_{a}")), 2), AXES, F.lit(0.0))


def _before(level: int) -> Column:
    """The first node of a pair comes before or is the second, by cell."""
    a = F.struct(*[F.col(f"a_{_cell(x, level)}") for x in AXES])
    b = F.struct(*[F.col(f"b_{_cell(x, level)}") for x in AXES])
    return a <= b


def _points(df: DataFrame, id_col: str, lon: str, lat: str, side: float) -> DataFrame:
    """Usable points with their places in space and the smallest cells, of width ``side``."""
    p = df.where(usable(lon, lat) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")).distinct()
    la, lo = F.radians("lat"), F.radians("lon")
    p = p.withColumns({"x": F.cos(la) * F.cos(lo) * EARTH_MEAN_M, "y": F.cos(la) * F.sin(lo) * EARTH_MEAN_M, "z": F.sin(la) * EARTH_MEAN_M})
    return p.withColumns({_cell(a, LEVELS - 1): F.floor(F.col(a) / side).cast("long") for a in AXES})


def _tree(p: DataFrame) -> dict[int, DataFrame]:
    """Nodes by level, from the leaves up; every level is an aggregate that is combined before its shuffle."""
    last = LEVELS - 1
    base = p.select(*[_cell(a, last) for a in AXES], F.lit(1).cast("long").alias("n"), *[F.col(a).alias(f"{s}_{a}") for a in AXES for s in ("lo", "hi")])
    nodes = {last: cut(base.groupBy(*[_cell(a, last) for a in AXES]).agg(*_box()))}
    for level in range(last - 1, -1, -1):
        up = nodes[level + 1].withColumns({_cell(a, level): F.floor(F.col(_cell(a, level + 1)) / FANOUT).cast("long") for a in AXES})
        nodes[level] = up.groupBy(*[_cell(a, level) for a in AXES]).agg(*_box())
    return nodes


def _units(one: dict[int, DataFrame], two: dict[int, DataFrame], chord: float, leaf_points: int, own: bool) -> DataFrame:
    """Pairs of cells to join: level, the cells and whether all their points are sure to be near."""
    last = LEVELS - 1
    # the top: each cell with its neighbours; with itself and half of them if both trees are one
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if not own or (i, j, k) >= (0, 0, 0)]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(a) for a, v in zip(AXES, s)]) for s in around]))
    a_side = _renamed(one[0], "a").withColumn("_s", step)
    frontier = a_side.join(_renamed(two[0], "b"), [F.col(f"a_{a}0") + F.col(f"_s.{a}") == F.col(f"b_{a}0") for a in AXES]).drop("_s")
    units = []
    for level in range(LEVELS):
        cells = [f"{s}_{_cell(a, level)}" for s in "ab" for a in AXES]
        f = frontier.where(_gap2() <= (chord + SLACK_M) ** 2)
        sure = _span2() <= max(0.0, chord - SLACK_M) ** 2
        leaf = (F.col("a_n") <= leaf_points) & (F.col("b_n") <= leaf_points) if level < last else F.lit(True)
        f = cut(f.select("*", sure.alias("_sure"), leaf.alias("_leaf")))
        done = f.where(F.col("_sure") | F.col("_leaf"))
        units.append(done.select(F.lit(level).alias("level"), *[F.col(c).alias(f"{s}{a}") for c, (s, a) in zip(cells, [(s, a) for s in "ab" for a in AXES])], F.col("_sure").alias("sure")))
        if level == last:
            break
        rest = f.where(~F.col("_sure") & ~F.col("_leaf")).select(*cells)
        for tree, side in ((one, "a"), (two, "b")):
            below = tree[level + 1].withColumns({_cell(a, level): F.floor(F.col(_cell(a, level + 1)) / FANOUT).cast("long") for a in AXES})
            rest = rest.join(_renamed(below, side), [f"{side}_{_cell(a, level)}" for a in AXES])
        if own:
            same = reduce(lambda s, a: s & (F.col(f"a_{_cell(a, level)}") == F.col(f"b_{_cell(a, level)}")), AXES, F.lit(True))
            rest = rest.where(~same | _before(level + 1))
        frontier = rest.drop(*cells)
    return cut(reduce(DataFrame.unionByName, units))


def _unit_points(p: DataFrame, units: DataFrame, sides: str, block_rows: int) -> DataFrame:
    """The points of each cell of a unit, by level and cell; big cells are dealt to blocks."""
    last = LEVELS - 1
    up = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), *[F.floor(F.col(_cell(a, last)) / FANOUT ** (last - level)).cast("long").alias(a) for a in AXES]) for level in range(LEVELS)]))
    pts = p.select("id", "lon", "lat", up.alias("k")).select("id", "lon", "lat", F.col("k.level").alias("level"), *[F.col(f"k.{a}").alias(f"c{a}") for a in AXES])
    key = ["level", *[f"c{a}" for a in AXES]]
    used = reduce(DataFrame.union, [units.select("level", *[F.col(f"{s}{a}").alias(f"c{a}") for a in AXES]) for s in sides]).distinct()
    return cut(with_blocks(pts.join(used, key, "left_semi"), key, "id", block_rows))


def _joined(units: DataFrame, points: dict[str, DataFrame], radius_m: float, own: bool) -> DataFrame:
    """Pairs ``a_id``, ``b_id`` of the points of the units that are near."""
    u = units
    for s in "ab":
        sizes = points[s].where(F.col("_blocks") > 1).select("level", *[F.col(f"c{a}").alias(f"{s}{a}") for a in AXES], F.col("_blocks").alias(f"_n{s}")).distinct()
        u = u.join(sizes, ["level", *[f"{s}{a}" for a in AXES]], "left")
        u = u.withColumn(f"_b{s}", F.explode(F.sequence(F.lit(0), F.coalesce(f"_n{s}", F.lit(1)) - 1)))
    same = reduce(lambda s, a: s & (F.col(f"a{a}") == F.col(f"b{a}")), AXES, F.lit(own))
    u = u.withColumn("own", same).where(~F.col("own") | (F.col("_ba") <= F.col("_bb")))
    for s in "ab":
        side_pts = points[s].select("level", *[F.col(f"c{a}").alias(f"{s}{a}") for a in AXES], F.col("_block").alias(f"_b{s}"), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "lon", "lat")])
        u = u.join(side_pts, ["level", *[f"{s}{a}" for a in AXES], f"_b{s}"])
    near = F.col("sure") | (haversine_m("a_lon", "a_lat", "b_lon", "b_lat") <= radius_m)
    if own:
        once = ~F.col("own") | (F.col("_ba") != F.col("_bb")) | (F.col("a_id") < F.col("b_id"))
        near = near & (F.col("a_id") != F.col("b_id")) & once
    return u.where(near).select("a_id", "b_id")


def _scale(radius_m: float) -> tuple[float, float]:
    """Chord of a radius, and the width of the smallest cells: from 4 times the radius at the top to 1/16 of it."""
    if not radius_m > 0:
        raise ValueError("radius_m must be positive")
    chord = 2 * EARTH_MEAN_M * math.sin(min(radius_m / (2 * EARTH_MEAN_M), math.pi / 2))
    return chord, chord * FANOUT ** (2 - LEVELS)


def _several(p: DataFrame) -> bool:
    """Whether an id has several positions; only then a pair can be found twice."""
    return p.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0


def near_pairs(df: DataFrame, id_col: str, lon: str, lat: str, radius_m: float, leaf_points: int = LEAF_POINTS, block_rows: int = 2000) -> DataFrame:
    """Pairs of different ids at most ``radius_m`` apart: columns ``a`` < ``b``, each pair once.

    Coordinates that are null, NaN, both 0 or out of range take no part; an empty table gives no pairs. An id given
    with several positions is near another if any of its positions is. Extra columns are ignored.
    """
    chord, side = _scale(radius_m)
    p = _points(df, id_col, lon, lat, side)
    nodes = _tree(p)
    units = _units(nodes, nodes, chord, leaf_points, True)
    pts = _unit_points(p, units, "ab", block_rows)
    out = _joined(units, {"a": pts, "b": pts}, radius_m, True).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    return out.distinct() if _several(p) else out


def near_points(left: DataFrame, left_id: str, right: DataFrame, right_id: str, lon: str, lat: str, radius_m: float, leaf_points: int = LEAF_POINTS, block_rows: int = 2000) -> DataFrame:
    """Pairs ``a`` of ``left`` and ``b`` of ``right`` at most ``radius_m`` apart, each pair once; both have ``lon`` and ``lat``.

    Ids of the two tables are kept apart, so equal ones may pair. Unusable coordinates, null ids, empty tables and ids with
    several positions as in ``near_pairs``.
    """
    chord, side = _scale(radius_m)
    a, b = _points(left, left_id, lon, lat, side), _points(right, right_id, lon, lat, side)
    units = _units(_tree(a), _tree(b), chord, leaf_points, False)
    out = _joined(units, {"a": _unit_points(a, units, "a", block_rows), "b": _unit_points(b, units, "b", block_rows)}, radius_m, False)
    out = out.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return out.distinct() if _several(a) or _several(b) else out


#: Widths in degrees of the cells that regions are walked over, from the top; the top has about a thousand in all.
CELL_DEGREES = (8.0, 2.0, 0.5, 0.125, 0.03125, 0.0078125)


def _inside(px: str, py: str) -> str:
    """SQL: whether a point is inside ``edges``, by the parity of edges to its right; points on an edge belong to one side of it."""
    hit = f"(e.y1 > {py}) <> (e.y2 > {py}) and {px} < (e.x2 - e.x1) * ({py} - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1"
    return f"(size(filter(edges, e -> coalesce({hit}, false))) % 2 = 1)"


def containing_regions(points: DataFrame, point_id: str, lon: str, lat: str, regions: DataFrame, region_id: str, ring: str, leaf_points: int = LEAF_POINTS, block_rows: int = 20_000) -> DataFrame:
    """Pairs ``point``, ``region`` for each point inside a region, each once.

    ``ring`` is an array of structs of ``x`` (longitude) and ``y`` (latitude): the corners of a simple polygon in degrees, closed
    by itself, which doesn't cross the 180th meridian. Rings that are null or have less than three corners contain nothing.
    A point in several regions has several rows, one in none has none. Unusable coordinates and null ids take no part.
    """
    last = len(CELL_DEGREES) - 1
    cell = lambda c, level: F.floor(F.col(c) / CELL_DEGREES[level]).cast("int")
    p = points.where(usable(lon, lat) & F.col(point_id).isNotNull()).select(F.col(point_id).alias("point"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")).distinct()
    p = p.withColumns({"cx": cell("x", last), "cy": cell("y", last)})
    grid = 4  # cells of a level in one of the level above, along each axis
    nodes = {last: cut(p.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))}
    for level in range(last - 1, -1, -1):
        up = nodes[level + 1].withColumns({c: F.floor(F.col(c) / grid).cast("int") for c in ("cx", "cy")})
        nodes[level] = up.groupBy("cx", "cy").agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    shape = regions.where(F.col(region_id).isNotNull() & (F.size(ring) >= 3)).select(F.col(region_id).alias("region"), F.transform(ring, lambda q: F.struct(q["x"].cast("double").alias("x"), q["y"].cast("double").alias("y"))).alias("r"))
    edges = F.expr("transform(r, (q, i) -> named_struct('x1', q.x, 'y1', q.y, 'x2', r[(i + 1) % size(r)].x, 'y2', r[(i + 1) % size(r)].y))")
    shape = shape.select("region", edges.alias("edges"), *[F.expr(f"array_{f}(transform(r, q -> q.{c}))").alias(n) for n, f, c in (("rx0", "min", "x"), ("rx1", "max", "x"), ("ry0", "min", "y"), ("ry1", "max", "y"))])
    shape = cut(shape)
    # the top: the cells that a region's box touches
    top = shape.select("region", *[F.explode(F.sequence(cell(f"r{c}0", 0), cell(f"r{c}1", 0))).alias(f"c{c}") if c == "x" else F.sequence(cell("ry0", 0), cell("ry1", 0)).alias("_ys") for c in "xy"])
    frontier = top.select("region", "cx", F.explode("_ys").alias("cy")).join(nodes[0], ["cx", "cy"])
    units = []
    for level in range(last + 1):
        f = frontier.join(shape, "region").where("x1 >= rx0 and x0 <= rx1 and y1 >= ry0 and y0 <= ry1")
        # no edge's box meets the cell's: the cell lies inside or outside as a whole
        clear = F.expr("not exists(edges, e -> greatest(e.x1, e.x2) >= x0 and least(e.x1, e.x2) <= x1 and greatest(e.y1, e.y2) >= y0 and least(e.y1, e.y2) <= y1)")
        f = f.withColumn("sure", clear).where(~F.col("sure") | F.expr(_inside("x0", "y0")))
        leaf = F.lit(True) if level == last else F.col("n") <= leaf_points
        f = cut(f.select("region", "cx", "cy", "sure", (F.col("sure") | leaf).alias("_done")))
        units.append(f.where("_done").select("region", F.lit(level).alias("level"), "cx", "cy", "sure"))
        if level < last:
            below = nodes[level + 1].withColumnsRenamed({"cx": "nx", "cy": "ny"}).withColumns({"cx": F.floor(F.col("nx") / grid).cast("int"), "cy": F.floor(F.col("ny") / grid).cast("int")})
            frontier = f.where("not _done").select("region", "cx", "cy").join(below, ["cx", "cy"]).drop("cx", "cy").withColumnsRenamed({"nx": "cx", "ny": "cy"})
    u = cut(reduce(DataFrame.unionByName, units))
    up = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), *[F.floor(F.col(c) / grid ** (last - level)).cast("int").alias(c) for c in ("cx", "cy")]) for level in range(last + 1)])).alias("k")
    at = p.select("point", "x", "y", up).select("point", "x", "y", "k.level", "k.cx", "k.cy")
    key = ["level", "cx", "cy"]
    at = cut(with_blocks(at.join(u.select(*key).distinct(), key, "left_semi"), key, "point", block_rows))
    sizes = at.where("_blocks > 1").select(*key, F.col("_blocks").alias("_nb")).distinct()
    u = u.join(sizes, key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_nb", F.lit(1)) - 1))).drop("_nb")
    j = u.join(shape.select("region", "edges"), "region").join(at.drop("_blocks"), [*key, "_block"])
    return j.where(F.col("sure") | F.expr(_inside("x", "y"))).select("point", "region").distinct()
