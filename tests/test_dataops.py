"""Nearby points, snapshot changes and the bitemporal ledger against brute force, with dirty input."""

import bisect
import math
import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rookery.operators.bitemporal import bitemporal_ledger
from rookery.operators.blocks import pairs_in_groups
from rookery.operators.near import containing_regions, near_pairs, near_points
from rookery.operators.ranks import cumulative, global_order
from rookery.operators.snapshots import snapshot_changes

R = 6_371_008.8


def metres(p, q):
    (x1, y1), (x2, y2) = p, q
    a = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1, a)))


def brute(points, r):
    return {(min(i, j), max(i, j)) for i, p in points for j, q in points if i < j and metres(p, q) <= r}


@pytest.mark.parametrize("radius", [30.0, 80.0, 900.0])
def test_near_pairs_equal_brute_force(spark, radius):
    rnd = random.Random(1)
    pts = [(i, (121.0 + rnd.gauss(0, 0.004), 31.0 + rnd.gauss(0, 0.004))) for i in range(300)]
    pts += [(1000 + i, (179.9999 if i % 2 else -179.9999, 0.0005 * i)) for i in range(20)]  # across the 180th meridian
    pts += [(2000 + i, (18.0 * i - 180, 89.9998)) for i in range(20)]  # around the pole
    pts += [(3000 + i, pts[0][1]) for i in range(40)]  # one place
    df = spark.createDataFrame([(i, p[0], p[1], "x") for i, p in pts], "id long, lon double, lat double, a string")
    got = [tuple(r) for r in near_pairs(df, "id", "lon", "lat", radius, leaf_points=4, block_rows=16).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(pts, radius)


def test_near_pairs_dirty_and_empty(spark):
    nan = float("nan")
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, None, 1.0), (4, nan, 1.0), (5, 200.0, 1.0), (6, 1.0, 95.0), (7, 10.0, 10.0), (8, 10.0, 10.0), (8, 10.0, 10.0), (None, 10.0, 10.0), (9, 0.0, 1e-4), (10, 0.0, 1e-4)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    assert {tuple(r) for r in near_pairs(df, "id", "lon", "lat", 80.0).collect()} == {(7, 8), (9, 10)}
    assert near_pairs(df.limit(0), "id", "lon", "lat", 80.0).count() == 0
    with pytest.raises(ValueError):
        near_pairs(df, "id", "lon", "lat", 0)


@pytest.mark.parametrize("radius", [40.0, 700.0])
def test_near_points_of_two_tables(spark, radius):
    rnd = random.Random(3)
    place = lambda n: [(i, 121.0 + rnd.gauss(0, 0.004), 31.0 + rnd.gauss(0, 0.004)) for i in range(n)]
    one, two = place(150), place(200)
    two += [(1000 + i, one[0][1], one[0][2]) for i in range(30)] + [(2000, 179.9999, 0.001), (2001, None, 1.0), (None, one[0][1], one[0][2])]
    one += [(3000, -179.9999, 0.001), (3001, 0.0, 0.0)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, lon double, lat double").withColumn("a_id", F.lit(1))
    got = [tuple(r) for r in near_points(frame(one), "id", frame(two), "id", "lon", "lat", radius, leaf_points=4, block_rows=16).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a, *p in one for b, *q in two if None not in (b, *q) and p != [0.0, 0.0] and metres(p, q) <= radius}
    assert near_points(frame(one).limit(0), "id", frame(two), "id", "lon", "lat", radius).count() == 0


def test_containing_regions(spark):
    rnd = random.Random(4)
    star = lambda x, y, r, n: [(x + r * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rings = {f"r{i}": star(rnd.uniform(100, 120), rnd.uniform(20, 40), 10 ** rnd.uniform(-2, 1), rnd.randrange(3, 12)) for i in range(25)}
    pts = [(i, rnd.uniform(95, 125), rnd.uniform(15, 45)) for i in range(300)]
    pts += [(1000 + i, x + rnd.gauss(0, 0.01), y + rnd.gauss(0, 0.01)) for i, (x, y) in enumerate(rnd.choice(list(rings.values()))[0] for _ in range(300))]
    pts += [(5000 + i, *rings["r3"][0]) for i in range(5)] + [(6000, None, 1.0), (None, 110.0, 30.0)]

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            odd ^= ((y1 > y) != (y2 > y)) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return odd

    p = spark.createDataFrame(pts, "id long, lon double, lat double").withColumn("region", F.lit("clash"))
    r = spark.createDataFrame([(k, v) for k, v in rings.items()] + [("none", None), ("line", [(1.0, 2.0), (3.0, 4.0)]), (None, rings["r0"])], "name string, ring array<struct<x:double,y:double>>")
    got = [tuple(x) for x in containing_regions(p, "id", "lon", "lat", r, "name", "ring", leaf_points=8, block_rows=16).collect()]
    want = {(i, k) for i, x, y in pts if None not in (i, x) for k, ring in rings.items() if inside(x, y, ring)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    assert containing_regions(p.limit(0), "id", "lon", "lat", r, "name", "ring").count() == 0
    assert containing_regions(p, "id", "lon", "lat", r.limit(0), "name", "ring").count() == 0


def test_pairs_in_groups_by_blocks(spark):
    rows = [("hot", i) for i in range(120)] + [("b", i) for i in range(3)] + [(None, 1), (None, 2), ("c", 9)]
    got = [tuple(r) for r in pairs_in_groups(spark.createDataFrame(rows, "k string, id long"), ["k"], "id", 16).collect()]
    want = [(i, j) for i in range(120) for j in range(i + 1, 120)] + [(0, 1), (0, 2), (1, 2)]
    assert sorted(got) == sorted(want)


def test_global_order_and_cumulative(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("k"))
    got = [(r["_pos"], r["k"], r["id"]) for r in global_order(df, [F.col("k"), F.col("id")], 5).collect()]
    assert [p[0] for p in sorted(got)] == list(range(500))
    assert [x[1:] for x in sorted(got)] == sorted(x[1:] for x in got)
    c = cumulative(df.groupBy("k").agg(F.count(F.lit(1)).alias("w")), ["k"], "w", 3).collect()
    total = 0
    for r in sorted(c, key=lambda r: r["k"]):
        total += r["w"]
        assert r["_upto"] == total


def test_snapshot_changes(spark):
    d1, d2, d3 = date(2026, 1, 1), date(2026, 1, 4), date(2026, 1, 5)
    t = lambda h: datetime(2026, 1, 1, h, tzinfo=timezone.utc)
    rows = [
        (d1, "s", "1", "a", 10, t(1)), (d1, "s", "2", "b", None, t(1)), (d1, "s", "3", "c", 5, t(1)), (d1, "s", "3", "old", 9, t(0)), (d1, None, "9", "n", 1, t(1)),
        (d2, "s", "1", "a 　", 10, t(1)), (d2, "s", "2", "b", 7, t(2)), (d2, "s", "2", "b", 7, t(2)), (d2, "s", "4", "d", 1, None), (d2, None, "9", "n", 2, t(1)),
        (d3, "s", "1", "a", 10, t(1)), (d3, "s", "3", "c", 5, t(1)), (d3, "s", "2", "b", 7, t(2)), (d3, "s", "4", None, 1, t(1)), (d3, None, "9", "n", 2, t(1)),
        (None, "s", "8", "z", 1, t(1)),
    ]
    df = spark.createDataFrame(rows, "day date, source string, id string, title string, rent int, seen timestamp").withColumn("change", F.lit(1))
    out = snapshot_changes(df, "day", ["source", "id"], ["title", "rent"], "seen", ("title",))
    got = {(str(r["day"]), r["source"], r["id"], r["change"]) for r in out.collect()}
    assert got == {("2026-01-04", "s", "2", "changed"), ("2026-01-04", "s", "3", "removed"), ("2026-01-04", "s", "4", "added"), ("2026-01-04", None, "9", "changed"), ("2026-01-05", "s", "3", "added"), ("2026-01-05", "s", "4", "changed")}
    assert snapshot_changes(df.limit(0), "day", ["source", "id"], ["title", "rent"], "seen").count() == 0


def ledger_by_arrival(obs):
    """Arrivals one by one into a list of live intervals."""
    first = defaultdict(dict)
    for k, v, run, val in obs:
        rank = (run if run is not None else 1 << 62, val is not None, val or 0)
        if v not in first[k] or rank < first[k][v][0]:
            first[k][v] = (rank, run, val)
    rows = Counter()
    for k, ev in first.items():
        live = {}
        for v, (rank, run, val) in sorted(ev.items(), key=lambda x: (x[1][0][0], x[0])):
            starts = sorted(live)
            j, end = bisect.bisect_left(starts, v), None
            if j:
                p = starts[j - 1]
                end, pv, rec = live[p]
                rows[k, p, end, pv, rec, run, True] += 1
                live[p] = (v, pv, run)
            elif starts:
                end = starts[0]
            live[v] = (end, val, run)
        for p, (end, pv, rec) in live.items():
            rows[k, p, end, pv, rec, None, False] += 1
    return rows


@pytest.mark.parametrize("hot", [None, 10])
def test_bitemporal_ledger(spark, hot):
    rnd = random.Random(5)
    t0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
    obs = []
    for k in ["a", "b", "c", None, "rev"]:
        for i in range(60 if k != "c" else 1):
            v = rnd.randrange(80)
            run = None if rnd.random() < 0.05 else 200 - v if k == "rev" else v // 3 + (rnd.randrange(12) if rnd.random() < 0.3 else 0)
            obs.append((k, v, run, rnd.choice([None, 1, 2, 3])))
    df = spark.createDataFrame([(k, t0 + timedelta(seconds=v), run, val, 1) for k, v, run, val in obs] + [("a", None, 1, 1, 1)], "k string, at timestamp, run int, val int, v int")
    more = {} if hot is None else {"hot_rows": hot, "chunk_rows": 7}
    got = bitemporal_ledger(df, ["k"], "at", "run", ["val"], **more).collect()
    us = lambda x: None if x is None else (x - int(t0.timestamp()) * 1_000_000) // 1_000_000
    assert Counter((r["k"], us(r["valid_from"]), us(r["valid_to"]), r["val"], r["recorded_from"], r["recorded_to"], r["superseded"]) for r in got) == ledger_by_arrival(obs)
    opens = {(r["k"], us(r["valid_from"])) for r in got if r["opens_version"]}
    want = set()
    per = defaultdict(dict)
    for k, v, run, val in obs:
        rank = (run if run is not None else 1 << 62, val is not None, val or 0)
        if v not in per[k] or rank < per[k][v][0]:
            per[k][v] = (rank, val)
    for k, ev in per.items():
        standing, n = None, 0
        for v in sorted(ev):
            new = ev[v][1] if ev[v][1] is not None else standing
            if n == 0 or new != standing:
                want.add((k, v))
            standing, n = new, n + 1
    assert opens == want
    assert bitemporal_ledger(df.limit(0), ["k"], "at", "run", ["val"]).count() == 0
