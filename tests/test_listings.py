"""Listing operators on the pinned values, and the contract with the driver."""

from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F, types as T

from rookery import sinks
from rookery.functions.geo import haversine_m_int
from rookery.functions.text import area_sqm, clean_text, epoch_time, first_int, head_and_rest, iso_time, layout_parts, price_bounds, trailing_id
from rookery.operators import distributions as dist, history as hist, layers, location, quality, store
from rookery.rules import Rules
from rookery.sources import pages
from rookery.streaming import observations as stream

UTC = timezone.utc


def test_quartiles_and_ranks(spark):
    df = spark.createDataFrame([("g", v) for v in (4000, 4500, 5000, 6000)] + [("h", 7), ("g", None)], "k string, v int")
    s = {r["k"]: r for r in dist.distribution_stats(df, ["k"], "v").collect()}
    assert (s["g"]["n"], s["g"]["p25"], s["g"]["median"], s["g"]["p75"], s["g"]["iqr"]) == (4, 4500, 4750, 5000, 500)
    assert s["h"]["n"] == 1 and s["h"]["iqr"] == 0
    r = dist.percentile_ranks(spark.createDataFrame([("g", 4000), ("g", 4500), ("g", 5000), ("h", 1), ("t", 1), ("t", 1), ("t", 2)], "k string, v int"), ["k"], "v", "p").collect()
    assert sorted((x["k"], x["v"], x["p"]) for x in r) == [("g", 4000, 0.0), ("g", 4500, 0.5), ("g", 5000, 1.0), ("h", 1, 0.0), ("t", 1, 0.5), ("t", 1, 0.5), ("t", 2, 1.0)]
    assert dist.distribution_stats(df.limit(0), ["k"], "v").count() == 0


def test_buckets_and_distance(spark):
    df = spark.createDataFrame([(m,) for m in (3999, 4000, 7999, 8000, 12000, 12001, None)], "m int")
    assert [r[0] for r in df.select(dist.bucket(F.col("m"))).collect()] == ["near", "middle", "middle", "far", "far", "beyond", None]
    m = spark.range(1).select(haversine_m_int(F.lit(121.5), F.lit(31.23), F.lit(121.51), F.lit(31.23))).first()[0]
    assert 900 < m < 1100


def test_quality_and_duplicates(spark):
    schema = "listing_id string, title string, description string, rent_price int, area_sqm double, district string, subdistrict string, community_name string, longitude double, latitude double, published_at timestamp, sub string"
    t = datetime(2026, 5, 1, tzinfo=UTC)
    base = lambda i, **k: tuple({"listing_id": i, "title": f"t{i}", "description": None, "rent_price": 4000, "area_sqm": 50.0, "district": "d", "subdistrict": "芳虹镇", "community_name": f"c{i}", "longitude": 112.4, "latitude": 30.6, "published_at": t, "sub": "x"} | k for _ in (0,))[0]
    rows = [base("1"), base("2", title=" same", community_name="c"), base("3", title="same　", community_name="c "), base("4", area_sqm=1.0), base("5", longitude=None), base("6", rent_price=None), base("7", area_sqm=float("nan"), published_at=None), base("8", subdistrict=None)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    q = {r["listing_id"]: r for r in quality.quality_rows(df).collect()}
    assert q["1"]["tier"] == "ready" and q["1"]["notes"] == "core_fields_usable"
    assert q["2"]["possible_duplicate"] and q["3"]["possible_duplicate"] and not q["1"]["possible_duplicate"]
    assert q["4"]["area_outlier"] and not q["4"]["can_analyze_area_price"] and q["4"]["can_analyze_map"]
    assert q["5"]["tier"] == "blocked" and q["6"]["tier"] == "blocked" and q["8"]["tier"] == "caution"
    assert not q["7"]["area_outlier"] and q["7"]["rent_per_sqm"] is None
    s = quality.quality_summary(quality.quality_rows(df.limit(0))).first()
    assert s["total"] == 0 and s["tier_ready"] == 0


def test_density_clusters(spark):
    pts = [(str(i), 112.4 + 0.0004 * i, 30.6) for i in range(1, 6)] + [("9", 112.6, 30.6)]
    df = spark.createDataFrame(pts, "id string, longitude double, latitude double")
    got = {r["id"]: r for r in location.density_clusters(df, "id", Rules(eps_m=120.0, min_samples=3)).collect()}
    assert {got[str(i)]["cluster"] for i in range(1, 6)} == {"c00001"} and got["1"]["cluster_size"] == 5
    assert got["9"]["cluster"] == "noise" and got["9"]["cluster_size"] == 0 and got["9"]["centroid_lon"] is None
    assert got["3"]["is_core"]
    with pytest.raises(ValueError):
        location.density_clusters(df, "id", Rules(eps_m=0))
    assert location.density_clusters(df.limit(0), "id").count() == 0


def test_components_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n)], "a string, b string")
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(n + 1)] + [("zzz",)], "id string")
    got = {r["id"]: r["root"] for r in location.components(edges, nodes).collect()}
    assert set(got.values()) == {"000", "zzz"} and got["zzz"] == "zzz"


def test_price_history_across_spans(spark):
    t = datetime(2026, 5, 1, tzinfo=UTC)
    rows = [("s", "1", t, 4500), ("s", "1", t + timedelta(days=9), None), ("s", "1", t + timedelta(days=20), 4300), ("s", "1", t + timedelta(days=21), 4600), ("s", "2", t, None), ("s", "2", t + timedelta(days=40), 0), ("s", "2", t + timedelta(days=41), 5)]
    df = spark.createDataFrame(rows, "source string, source_listing_id string, observed_at timestamp, rent_price int")
    h = sorted(hist.price_history(df, hist.KEYS, "observed_at", "rent_price", [F.lit(0)]).collect(), key=lambda r: (r["source_listing_id"], r["observed_at"]))
    assert [r["delta"] for r in h] == [None, None, -200, 300, None, None, 5]
    assert [r["direction"] for r in h[:4]] == ["first_or_unknown", "first_or_unknown", "down", "up"]
    assert h[2]["delta_share"] == -0.0444 and h[3]["delta_from_first"] == 100 and h[3]["delta_from_lowest"] == 300 and h[6]["delta_share"] is None


def test_reconcile(spark):
    df = lambda ids: spark.createDataFrame([("s", i) for i in ids], "source string, source_listing_id string")
    state = spark.createDataFrame([("s", "B", "active")], "source string, source_listing_id string, status string")
    marks, s = hist.reconcile(df("AB"), df("A"), state, hist.KEYS, 10)
    assert [(r["source_listing_id"], r["status"]) for r in marks.collect()] == [("B", "out_of_window")]
    assert s.first()["newly_out_of_window"] == 1 and not s.first()["is_full"]
    again = spark.createDataFrame([("s", "B", "out_of_window")], "source string, source_listing_id string, status string")
    marks, s = hist.reconcile(df("AB"), df("A"), again, hist.KEYS, 10)
    assert marks.count() == 0 and s.first()["already_out_of_window"] == 1
    marks, s = hist.reconcile(df("AB"), df("AC"), state, hist.KEYS, 2)
    assert s.first()["is_full"] and s.first()["newly_offline"] == 1 and s.first()["in_scope_seen"] == 1


def test_store(spark):
    cols = "source string, id string, rent int, first int"
    old = spark.createDataFrame([("s", "1", 10, 1), ("s", "2", 20, 1)], cols)
    new = spark.createDataFrame([("s", "2", 21, 5, 1), ("s", "2", 22, 6, 2), ("s", "3", 30, 7, 3), (None, "4", 1, 1, 4)], cols + ", seq int")
    got = sorted(map(tuple, store.upsert(old, new, ["source", "id"], "seq", "first").collect()))
    assert got == [("s", "1", 10, 1), ("s", "2", 22, 1), ("s", "3", 30, 7)]
    assert sorted(map(tuple, store.upsert(old, new, ["source", "id"], "seq", "first", compat=True).collect()))[1] == ("s", "2", 22, 6)
    assert [tuple(r) for r in store.insert_or_ignore(old, new, ["source", "id"], "seq").collect()] == [("s", "3", 30, 7)]
    runs = store.append_with_id(spark.createDataFrame([(1, "a")], "id long, x string"), spark.createDataFrame([("b",)], "x string"))
    assert sorted(map(tuple, runs.collect())) == [(1, "a"), (2, "b")]
    legacy = spark.createDataFrame([("s", "7", "junk")], "source string, rent string, payload string")
    m = store.migrate(legacy, T.StructType([T.StructField("source", T.StringType()), T.StructField("rent", T.IntegerType()), T.StructField("status", T.StringType())]), {"status": "active"})
    assert m.columns == ["source", "rent", "status"] and tuple(m.first()) == ("s", 7, "active")
    gap = lambda *n: store.first_gap(spark.createDataFrame([(x,) for x in n], "n int"), "n").first()[0]
    assert gap(1, 2, 4) == 3 and gap(2) == 1 and gap(1, 2) == 3


def test_longest_prefix(spark):
    t = spark.createDataFrame([("ab", "X"), ("abc", "Z"), ("abc", "Y"), ("q", "Q")], "p string, name string")
    v = spark.createDataFrame([("abcd",), ("abx",), ("zzz",), ("",), (None,)], "v string")
    assert {tuple(r) for r in store.longest_prefix(v, "v", t, "p", "name").collect()} == {("abcd", "Y"), ("abx", "X"), ("zzz", None), ("", None)}


def test_layers(spark):
    a = spark.createDataFrame([("1", 10, True), ("2", None, None)], "id string, x int, flag boolean")
    b = spark.createDataFrame([("1", 99, 5)], "id string, x int, y int")
    m = layers.merge_layers(a, [(b, ["x", "y", "nothing"])], "id")
    assert m.columns == ["id", "x", "flag", "y"]
    assert layers.facet_filter(m, {"x": (20, 0)}).count() == 1
    assert layers.facet_filter(m, {}, {"id": []}).count() == 2 and layers.facet_filter(m, {}, None, {"id": []}).count() == 0
    assert layers.facet_filter(m, {}, without=("flag",)).count() == 1 and layers.facet_filter(m, {}, only=("flag",)).count() == 1
    s = layers.weighted_scores(a, {"x": 0.0}, {}).collect()
    assert {r["value_score"] for r in s} == {50.0}
    assert layers.score_levels(layers.weighted_scores(a, {"x": 1.0}, {})).first()["value_level"] == "neutral"
    assert a.select(layers.reasons([(F.col("flag"), "yes")], "none").alias("r")).collect()[1]["r"] == ["none"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(clean_text(F.lit(" <b>A&amp;B</b>　  c "))) == "A&B c"
    assert one(first_int(F.lit("¥4,500/月"))) == 4500 and one(first_int(F.lit("none"))) is None
    assert tuple(one(price_bounds(F.lit("3000-4500")))) == (3000, 4500)
    assert one(area_sqm(F.lit("约45.5㎡"))) == 45.5
    assert tuple(one(layout_parts(F.lit("2室1厅")))) == (2, 1, None)
    assert tuple(one(head_and_rest(F.lit(" a　b c ")))) == ("a", "b c")
    assert one(trailing_id(F.lit("https://h.example/r/123?x=1"))) == "123" and one(trailing_id(F.lit("not a url"))) is None
    assert one(iso_time(F.lit("2026-05-01T00:00:00Z"))) == one(iso_time(F.lit("2026-05-01")))
    assert one(epoch_time(F.lit("1767225600"))) == one(epoch_time(F.lit(1767225600))) and one(epoch_time(F.lit("x"))) is None


def test_more_text_and_sources(spark, tmp_path):
    from rookery.functions.text import area_guess, subway_text, translated_prefix
    from rookery.sources import missing_layers, typed_csv

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(subway_text(F.lit('[{"name":"A","lines":["2","7"],"distance":350.4}]'))) == "A(2/7, 350m)" and one(subway_text(F.lit(" near A "))) == "near A"
    assert one(translated_prefix(F.lit("East ‘x’"), {"East": "东"})) == "东 'x'"
    guess = {"12 rd": (None, 0.0), "": (None, 0.0), "三林（东）": ("三林（东）", 0.1), "荷柳花园3期": ("荷柳", 0.5), "晶耀名邸": ("晶耀", 0.5), "金桥路2346弄": ("金桥路", 0.3), "上南三村": ("上南", 0.7), "星月大厦": ("星月", 0.4), "三林": ("三林", 0.3), "里": (None, 0.0), "长桥新苑里": ("长桥新", 0.5)}
    assert {t: tuple(one(area_guess(F.lit(t)))) for t in guess} == guess
    assert tuple(one(area_guess(F.lit("上南三村"), F.lit("known")))) == ("known", 0.9)
    (tmp_path / "a.csv").write_text("id,n,ok,x\n1,3.0,True,1.5\n,4,true,2\n2,bad,no,\n")
    assert [tuple(r) for r in typed_csv(spark, str(tmp_path / "a.csv"), "id string, n int, ok boolean, x double", ("ok",), "id").collect()] == [("1", 3, True, 1.5), ("2", None, False, None)]
    df = spark.range(1)
    assert missing_layers({"a": df, "b": df.limit(0)}) == ["b"]
    t = datetime(2026, 5, 1, tzinfo=UTC)
    li = spark.createDataFrame([("s", "1", 5, t, t + timedelta(days=3))], "source string, source_listing_id string, rent_price int, first_seen_at timestamp, last_seen_at timestamp")
    ob = spark.createDataFrame([("s", "9", t, 1, "offline", 0)], "source string, source_listing_id string, observed_at timestamp, rent_price int, availability_status string, days_on_market int")
    assert [r["source_listing_id"] for r in store.observations_or_listings(ob, li).collect()] == ["9"]
    got = store.observations_or_listings(ob.limit(0), li).first()
    assert (got["source_listing_id"], got["availability_status"], got["days_on_market"]) == ("1", "active", 3)


def test_pages(spark):
    body = '<title> T </title><span>户型</span> <span>2室</span><span>户型</span><span>3室</span><a href="/a">x</a><a href="/a">y</a><a href="b">z</a><script type="application/ld+json">[1]</script><script type="application/ld+json">{bad</script>'
    df = spark.createDataFrame([(1, body, "https://h.example/l/"), (2, None, None)], "k int, body string, base string")
    s = {r["k"]: r for r in pages.page_summary(df, "k", "body", "base").collect()}
    assert s[1]["title"] == "T" and s[1]["links"] == ["https://h.example/a", "https://h.example/l/b"] and s[2]["bytes"] == 0
    assert pages.label_values(df.where("k = 1"), "body").first()["labels"] == {"户型": "3室"}
    assert pages.ld_blocks(df, "body").count() == 0 and pages.html_cards(df, "body").count() == 0 and pages.api_items(df, "body").count() == 0
    p = spark.range(1).select(*pages.prefer({"rent": [F.lit(0), F.lit(None).cast("int"), F.lit(7)], "name": [F.lit(""), F.lit("n")]})).first()
    assert tuple(p) == (7, "n")
    assert spark.range(1).select(pages.overall_confidence([F.lit(0.0), F.lit(0.5), F.lit(1.0)])).first()[0] == 0.75


def test_captured_files_and_sinks(spark, tmp_path):
    for n, t in (("20260101_a.html", "old"), ("20260102_a.html", "new")):
        (tmp_path / n).write_text(t)
    got = pages.latest_capture(pages.read_captured(spark, str(tmp_path)), F.regexp_extract("name", "_(.*)", 1)).collect()
    assert [r["body"] for r in got] == ["new"]
    df = spark.createDataFrame([("1", True, None, ["a", "b"], float("nan"))], "id string, f boolean, s string, l array<string>, x double")
    sinks.write_csv(df, str(tmp_path / "csv"), single=True)
    assert [p.read_text() for p in (tmp_path / "csv").glob("*.csv")] == ['id,f,s,l,x\n1,True,"",a; b,NaN\n']
    assert sinks.as_json(df).first()[0] == '{"id":"1","f":true,"l":["a","b"]}'


def test_streams(spark, tmp_path):
    t = datetime(2026, 1, 1, tzinfo=UTC)
    df = spark.createDataFrame([("a", t, 1), ("a", t, 1), ("b", t + timedelta(hours=1), 2)], "id string, at timestamp, v int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.deliver_once(src, ["id", "v"], "at").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
    lv = ["fast", "slow", "ultra"]
    p = spark.createDataFrame([("fast",), ("ultra",), ("?",)], "p string").select(stream.slower_profile(F.col("p"), lv)).collect()
    assert [r[0] for r in p] == ["slow", "ultra", "slow"]


def test_contract_has_sql_for_known_queries_only():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["p5_found", "p7_found", "quality_rows", "price_area_rows", "location_value_rows", "geo_cluster_rows", "price_history", "latest_change", "value_level", "upsert_merge", "reconcile_full"])
def test_queries_equal_sql(spark, name):
    import os

    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(d):
        con.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    df = e.queries()[name](spark, d)
    cols = sorted(df.columns)
    rel = con.execute(e.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    norm = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    want = sorted(str([norm(r[names.index(c)]) for c in cols]) for r in rel.fetchall())
    assert sorted(str([norm(r[c]) for c in cols]) for r in df.collect()) == want


def snapshots(tmp_path, rows):
    """A folder with listing_snapshots of (date, id, title, rent, last_seen_at, delivered_at), times as full hours."""
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute("create table s(snapshot_date date, source varchar, source_listing_id varchar, title varchar, community_name varchar, district varchar, rent_price int, status varchar, last_seen_at timestamptz, delivered_at timestamptz)")
    for day, i, title, rent, seen, delivered in rows:
        con.execute("insert into s values (?, 's', ?, ?, null, null, ?, null, ?, ?)", [day, i, title, rent, f"{day} {seen:02d}:00:00+00", f"{day} {delivered:02d}:00:00+00"])
    con.execute(f"copy s to '{tmp_path}/listing_snapshots.parquet' (format parquet)")
    return str(tmp_path)


# dates that no query names; a stale row delivered late, a listing that comes back, and listings that come late
SNAPSHOTS = [
    ("2027-01-02", "1", "a", 10, 5, 6), ("2027-01-02", "1", "a2", 11, 4, 9), ("2027-01-02", "2", "b", 20, 5, 6),
    ("2027-01-09", "1", "a3", 12, 5, 6), ("2027-01-09", "3", "c", 30, 7, 8), ("2027-01-09", "3", "c0", 29, 6, 9),
    ("2027-02-01", "2", "b2", 21, 5, 6), ("2027-02-01", "3", "c2", 31, 5, 6), ("2027-02-01", "4", "d", 40, 5, 6),
]


def test_merges_take_all_snapshots(spark, tmp_path):
    import __spark_entry__ as e

    d = snapshots(tmp_path, SNAPSHOTS)
    us = lambda day, hour: int(datetime.fromisoformat(f"{day}T{hour:02d}:00:00+00:00").timestamp()) * 1_000_000
    # row by row in order, as the storage does it
    kept, added = {}, {}
    for day, i, title, rent, seen, _ in sorted(SNAPSHOTS, key=lambda r: (r[0], r[4], r[5])):
        first = kept[i][2] if i in kept else us(day, seen)
        kept[i] = (title, rent, first)
        if day > SNAPSHOTS[0][0] and i not in "12":
            added.setdefault(i, (title, rent))
    assert len(kept) == 4 and set(added) == {"3", "4"}
    assert {r["source_listing_id"]: (r["title"], r["rent_price"], r["first_us"]) for r in e.queries()["upsert_merge"](spark, d).collect()} == kept
    assert {r["source_listing_id"]: (r["title"], r["rent_price"]) for r in e.queries()["insert_or_ignore"](spark, d).collect()} == added


def test_partial_reconciliation_takes_the_last_snapshot(spark, tmp_path):
    import os

    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    for f in os.listdir(d):
        os.symlink(f"{d}/{f}", tmp_path / f)
    # the same tables, all snapshots a year later
    os.remove(tmp_path / "listing_snapshots.parquet")
    duckdb.execute(f"copy (select * replace (cast(snapshot_date + interval 1 year as date) as snapshot_date) from '{d}/listing_snapshots.parquet') to '{tmp_path}/listing_snapshots.parquet' (format parquet)")
    got, want = (sorted(map(str, e.queries()["reconcile_partial"](spark, x).collect())) for x in (str(tmp_path), d))
    assert got == want


def test_marker_stands_beside_all_listings(spark):
    import os

    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    want = {r[0] for r in duckdb.execute(f"select distinct listing_id::varchar from '{d}/rental_listings.parquet' where listing_id is not null").fetchall()}
    got = [r["listing_id"] for r in e.queries()["union_marker"](spark, d).collect()]
    assert set(got) - {None} == want | {"origin"} and got.count("origin") == 1
