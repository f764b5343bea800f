"""Captured pages with planted answers, files, origins, stored tables, streams, the command line, and rules of sessions."""

import json
import os
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from rookery import cli, sinks
from rookery.operators import history as hist, layers, origins, store
from rookery.session import checkpoint_folder
from rookery.sources import last_by_key, pages, read_events
from rookery.streaming import observations as stream

UTC = timezone.utc
TABLES = "/root/testdata/sf0.001"

DETAIL = """<html><head><title>Whole·Garden 2室1厅-rent</title><meta name="description" content="此房源位于上海浦东三林的长清小区,近地铁, &quot;good&quot;"></head>
<p class="content__title">
 整租·长清小区 2室1厅1卫 南 </p><div class="content__aside--title"> <span>4,500</span>元/月 <i></i></div>
<ul><li class="x">基本信息：</li><li>面积：45.5㎡</li><li>入住：随时入住</li><li>面积：46㎡</li><li><span class="label">朝向楼层：</span>南 中楼层/6层</li><li><span class="label">租赁方式：</span>整租</li></ul>
<p class="content__aside--tags"><i class="a">近地铁</i><i></i><i>精装&amp;新</i></p>
<script>g_conf.houseCode = 'SH1'; g_conf.name = '长清一村'; g_conf.coord = { longitude: '121.49', latitude: '31.15' }; g_conf.subway = [{"name":"上南","lines":["8"],"distance":500}];</script></html>"""


def test_detail_page_with_planted_answers(spark):
    rows = [(1, DETAIL, "https://h.example/zufang/X1.html"), (2, "<title>Bare-x</title>", "https://h.example/zufang/X2.html"), (3, "<p>nothing</p>", "https://h.example/zufang/X3.html"), (4, None, "u"), (5, "<p>nothing</p>", "https://h.example/zufang/X5.html")]
    d = pages.html_detail(spark.createDataFrame(rows, "k int, body string, url string"), "body", "url")
    cards = spark.createDataFrame([("X3", 1, "card", 10, "d"), ("X3", 0, "first", 11, "d0"), ("X2", 0, "c2", 12, "d2"), (None, 0, "n", 1, "n")], "item_id string, position int, title string, rent int, district string")
    r = {x["k"]: x for x in pages.with_fallback(d, cards, "item_id").collect()}
    a = r[1]
    assert (a["item_id"], a["title"], a["rent"], a["area"], a["layout"], a["orientation"], a["floor"]) == ("SH1", "整租·长清小区 2室1厅1卫 南", 4500, 46.0, "2室1厅1卫", "南", "中楼层/6层")
    assert (a["district"], a["subdistrict"], a["community"], a["longitude"], a["latitude"], a["available_from"]) == ("浦东", "三林", "长清一村", 121.49, 31.15, "随时入住")
    assert a["tags"] == ["近地铁", "精装&新"] and a["subway"] == "上南(8, 500m)" and a["overall_confidence"] == 0.91 and a["description"].endswith('"good"')
    assert (r[2]["title"], r[2]["rent"], r[2]["district"]) == ("Bare", 12, "d2") and (r[3]["title"], r[3]["rent"]) == ("first", 11)
    assert set(r) == {1, 2, 3}  # without a title there is no listing


def test_dirty_json_ld_and_labels(spark):
    one = {"@type": "RealEstateListing", "name": "A &amp; B", "offers": {"price": "¥4,500", "priceCurrency": "cny"}, "image": "one.jpg", "numberOfRooms": 2, "amenityFeature": [{"name": "x"}, {"name": ""}, {}]}
    body = '<script type="application/ld+json">{bad</script><script type="application/ld+json">[1, {"@type":"Other"}]</script>' + f'<script type="application/ld+json">[{{"name":"no type"}},{json.dumps(one)}]</script>' + f'<script type="application/ld+json">{json.dumps(one | {"name": "later"})}</script>'
    d = pages.ld_detail(spark.createDataFrame([(1, body), (2, None), (3, "")], "k int, body string"), "body", ["k"]).collect()
    assert [(r["k"], r["title"], r["rent"], r["currency"], r["rooms"], r["features"], r["images"]) for r in d] == [(1, "A & B", 4500, "CNY", 2, ["x"], ["one.jpg"])]
    html = '<div class="rounded-[8px] p"><span>押金</span><span> 押一付三 </span></div><span>押金</span><span>x</span><span>楼层</span><span>1</span><span>楼层</span> <span>2&amp;3</span><span>空</span><span> </span>'
    x = pages.label_values(spark.createDataFrame([(html,), (None,), ("",)], "body string"), "body").collect()
    assert x[0]["labels"] == {"押金": "押一付三", "楼层": "2&3"} and not x[2]["labels"]


def test_enrich_by_precedence(spark):
    items = spark.createDataFrame([("1", "addr", 0, "d", None, 31.0), ("2", "addr2", 7, "d", 121.0, 31.0)], "item_id string, address string, rent int, district string, longitude double, latitude double")
    ld = pages.ld_detail(spark.createDataFrame([("1", '<script type="application/ld+json">{"@type":"RealEstateListing","name":"N","offers":{"price":"5"},"floorSize":{"value":"40"},"numberOfRooms":"2","geo":{"longitude":121.5,"latitude":31.5},"address":{"streetAddress":"S"}}</script>')], "item_id string, body string"), "body", ["item_id"])
    labels = spark.createDataFrame([("1", {"押金": "D", "类型": "个人合租"})], "item_id string, labels map<string,string>")
    r = {x["item_id"]: x for x in pages.enrich(items, ld, labels, "item_id").collect()}
    assert (r["1"]["title"], r["1"]["rent"], r["1"]["community"], r["1"]["layout"], r["1"]["deposit"], r["1"]["listing_type"], r["1"]["longitude"], r["1"]["overall_confidence"]) == ("N", 5, "S", "2室0厅1卫", "D", "shared_rent", 121.5, 0.9)
    assert (r["2"]["title"], r["2"]["rent"], r["2"]["layout"], r["2"]["overall_confidence"]) == ("addr2", 7, None, 0.9)


def test_degrees_that_are_no_number_are_kept_and_say_nothing(spark):
    page = lambda x: '<script type="application/ld+json">{"@type":"RealEstateListing","name":"N","geo":{"longitude":%s,"latitude":31.5}}</script>' % x
    rows = [("1", page('"NaN"')), ("2", page("null")), ("3", page("121.5"))]
    ld = pages.ld_detail(spark.createDataFrame(rows, "item_id string, body string"), "body", ["item_id"])
    assert sorted((r["item_id"], repr(r["longitude"]), r["latitude"]) for r in ld.collect()) == [("1", "nan", 31.5), ("2", "None", 31.5), ("3", "121.5", 31.5)]
    items = spark.createDataFrame([("1", "a", 1, "d", 120.5, 31.0), ("2", "a", 1, "d", float("nan"), 31.0)], "item_id string, address string, rent int, district string, longitude double, latitude double")
    labels = spark.createDataFrame([], "item_id string, labels map<string,string>")
    assert sorted((r["item_id"], r["longitude"], r["latitude"]) for r in pages.enrich(items, ld, labels, "item_id").collect()) == [("1", 120.5, 31.5), ("2", None, 31.5)]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", ["api_items", "page_ld_detail", "page_enrichment"])
def test_page_queries_tell_nan_from_null_as_sql_does(spark, tmp_path, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    odd = "CASE listing_id % 3 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN {0} END AS {0}"
    con.execute(f"copy (select * replace ({odd.format('longitude')}, {odd.format('latitude')}) from '{TABLES}/rental_listings.parquet') to '{tmp_path}/rental_listings.parquet' (format parquet)")
    con.execute(f"create view rental_listings as select * from '{tmp_path}/rental_listings.parquet'")
    got = e.queries()[name](spark, str(tmp_path)).select("item_id" if name != "page_ld_detail" else "page_id", "longitude", "latitude")
    want = con.execute(f"select {', '.join(got.columns)} from ({e.oracle_sql()[name]})").fetchall()
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))


def test_saved_pages_and_events(spark, tmp_path):
    t = datetime(2026, 1, 1, tzinfo=UTC)
    df = spark.createDataFrame([("a", t), ("a", t), ("b", t), (None, t)], "body string, at timestamp")
    folder = str(tmp_path / "raw")
    assert pages.save_captured(df.limit(2), "body", "at", folder).count() == 1
    assert [r["body"] for r in pages.save_captured(df, "body", "at", folder).collect()] == ["b"]
    assert spark.read.parquet(folder).count() == 2 and pages.save_captured(df, "body", "at", folder).count() == 0
    (tmp_path / "log.jsonl").write_text('{"kind":"ok","n":1}\n{broken\n\n{"kind":"captcha"}\n')
    assert sorted(map(tuple, read_events(spark, str(tmp_path / "log.jsonl"), "kind string, n int").collect())) == [("captcha", None), ("ok", 1)]


def test_origins(spark, tmp_path):
    ok = json.dumps({"status": 1, "geocodes": [{"location": "121.5,31.2", "formatted_address": "X"}, {"location": "1,2"}]})
    bad = ['{"status":"0","geocodes":[{"location":"1,2"}]}', '{"status":"1","geocodes":[]}', '{"status":"1","geocodes":[{"location":"12"}]}', "{", None, '{"status":"1","geocodes":[{"location":"a,b"}]}']
    df = spark.createDataFrame([(ok,), *[(b,) for b in bad]], "body string")
    assert [tuple(r) for r in origins.from_geocode(df, "body", F.lit("w"), F.lit("n")).collect()] == [("w", "X", 121.5, 31.2)]
    path = str(tmp_path / "deep" / "o.json")
    assert origins.load_origin(path) is None
    origins.save_origin({"origin_id": "w", "name": "办公室", "longitude": 121.5, "latitude": 31.2}, path)
    assert origins.load_origin(path) == {"origin_id": "w", "name": "办公室", "longitude": 121.5, "latitude": 31.2}
    for broken in ("{", "[]", '{"longitude": 1}', '{"longitude": "x", "latitude": 1}'):
        open(path, "w").write(broken)
        assert origins.load_origin(path) is None
    assert origins.from_distances(spark.range(1), "id").count() == 0
    assert origins.marker(spark, {"name": "a", "longitude": 1, "latitude": 2}).first()["title"] == "origin: a"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), (" ", "c"), (None, "d")], "id string, v string").withColumn("n", F.monotonically_increasing_id())
    assert [(r["id"], r["v"]) for r in last_by_key(df, "id", [F.col("n")]).collect()] == [("1", "b")]
    x = spark.createDataFrame([("s", None, 1, datetime(2026, 1, 1, tzinfo=UTC))], "source string, title string, rent_price int, published_at timestamp")
    sinks.write_csv(sinks.validation_rows(x), str(tmp_path / "v"), single=True, bom=True)
    text = next((tmp_path / "v").glob("*.csv")).read_bytes().decode("utf-8")
    head, row = text.splitlines()
    assert text[0] == "﻿" and len(head.split(",")) == 25 and head.endswith("人工验证状态,人工备注") and row.startswith("s,") and "2026-01-01T00:00:00" in row


def test_stored_tables(spark, tmp_path):
    schema, keys = "source string, id string, rent int, first int", ["source", "id"]
    put = lambda rows: store.upsert_store(spark, str(tmp_path / "t"), schema, spark.createDataFrame(rows, schema + ", seq int"), keys, "seq", "first")
    assert store.current(spark, str(tmp_path / "t"), schema)[1] == 0
    put([("s", "1", 10, 1, 1), (None, "2", 1, 1, 1)])
    assert sorted(map(tuple, put([("s", "1", 11, 9, 1), ("s", "3", 30, 9, 1)]).collect())) == [("s", "1", 11, 1), ("s", "3", 30, 9)]
    x, number = store.current(spark, str(tmp_path / "t"), schema)
    assert number == 2 and x.count() == 2
    log, rows = str(tmp_path / "log"), [("s", "1", 10, 1), ("s", "1", 11, 2)]
    add = lambda rows: store.record_observations(spark, log, "source string, id string, rent int", spark.createDataFrame(rows, "source string, id string, rent int, seq int"), keys, "seq")
    assert [add(rows), add(rows), add([("s", "2", 5, 1)])] == [1, 0, 1]
    assert sorted(map(tuple, spark.read.parquet(log).collect())) == [("s", "1", 10), ("s", "2", 5)]
    good, bad = store.split_by_rules(spark.createDataFrame([(1,), (-1,), (None,)], "n int"), {"sign": F.col("n") >= 0})
    assert good.count() == 2 and bad.first()["violations"] == ["sign"]


def test_longest_prefix_of_any_length(spark):
    long = "x" * 300
    t = spark.createDataFrame([(long, "L"), ("x", "S"), ("", "E")], "p string, name string")
    v = spark.createDataFrame([(long + "y",), ("xy",), ("z",)], "v string")
    got = {len(r["v"]): r["name"] for r in store.longest_prefix(v, "v", t, "p", "name").collect()}
    assert got == {301: "L", 2: "S", 1: None}


def test_marks_are_not_repeated(spark):
    t = datetime(2026, 5, 1, tzinfo=UTC)
    log = spark.createDataFrame([("s", "A", t, "active", 1), ("s", "B", t, "active", 2)], "source string, source_listing_id string, observed_at timestamp, availability_status string, rent_price int")
    df = lambda ids: spark.createDataFrame([("s", i) for i in ids], "source string, source_listing_id string")
    state = lambda x: hist.latest(x, hist.KEYS, "observed_at", [F.lit(0)], ["availability_status"]).withColumnRenamed("availability_status", "status")
    marks, _ = hist.reconcile(df("AB"), df("A"), state(log), hist.KEYS, None)
    after = hist.with_marks(log, marks, F.lit(t + timedelta(days=1)))
    assert after.count() == 3 and hist.reconcile(df("AB"), df("A"), state(after), hist.KEYS, None)[0].count() == 0
    gone = hist.delisted(hist.latest(after, hist.KEYS, "observed_at", [F.lit(0)], ["availability_status"]), "availability_status", ("offline", "out_of_window"), "observed_at")
    assert [r["source_listing_id"] for r in gone.collect()] == ["B"]


@pytest.fixture()
def days(spark, tmp_path):
    """Observations of three days, a file for each, and all of them."""
    t0 = datetime(2026, 5, 1, tzinfo=UTC)
    rows = [("s", str(k), t0 + timedelta(days=d, hours=h), None if (k + d + h) % 5 == 0 else 100 + (k * 7 + d * 3 + h) % 11, ["active", "active", "offline"][(k + d) % 3]) for d in range(3) for k in range(4) for h in range(3)]
    df = spark.createDataFrame(rows, "source string, source_listing_id string, observed_at timestamp, rent_price int, availability_status string")
    for d in range(3):
        path = str(tmp_path / "tmp" / str(d))
        df.where(F.col("observed_at").cast("date") == F.lit((t0 + timedelta(days=d)).date())).coalesce(1).write.parquet(path)
        os.makedirs(tmp_path / "in", exist_ok=True)
        file = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.rename(f"{path}/{file}", tmp_path / "in" / f"{d}.parquet")
        os.utime(tmp_path / "in" / f"{d}.parquet", (1_700_000_000 + d, 1_700_000_000 + d))
    return df, str(tmp_path)


def _stream(spark, df, folder, run):
    q = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()


def test_running_prices_equal_the_batch(spark, days):
    df, folder = days
    tie = lambda: [F.coalesce("rent_price", F.lit(-1))]
    run = stream.running_prices(f"{folder}/out", hist.KEYS, "observed_at", "rent_price", tie)
    _stream(spark, df, folder, run)
    want = hist.price_history(df, hist.KEYS, "observed_at", "rent_price", tie())
    rows = lambda: sorted(map(str, spark.read.parquet(f"{folder}/out/rows").select(*want.columns).collect()))
    assert rows() == sorted(map(str, want.collect())) and spark.read.parquet(f"{folder}/out/rows").select("batch").distinct().count() == 3
    run(df, 0)  # delivered again: nothing changes
    assert rows() == sorted(map(str, want.collect()))


def test_latest_states_and_changes(spark, days):
    df, folder = days
    _stream(spark, df, folder, stream.latest_states(f"{folder}/out", hist.KEYS, "observed_at", "availability_status", lambda: [F.lit(0)]))
    x, number = store.current(spark, f"{folder}/out/state", "")
    want = hist.latest(df, hist.KEYS, "observed_at", [F.lit(0)], ["availability_status"])
    assert number == 3 and sorted(map(str, x.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    changes = spark.read.parquet(f"{folder}/out/changes").collect()
    # four first states, then only those that differ from the day before
    assert sum(r["previous"] is None for r in changes) == 4 and all(r["previous"] != r["availability_status"] for r in changes)
    assert len(changes) == 4 + sum(["active", "active", "offline"][(k + d) % 3] != ["active", "active", "offline"][(k + d - 1) % 3] for k in range(4) for d in (1, 2))


def test_captured_stream_goes_on(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def drain():
        q = stream.captured_pages(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    (folder / "a.html").write_text("one\ntwo")
    assert drain() == [("a.html", "one\ntwo")]
    (folder / "b.html").write_text("three")
    assert drain() == [("a.html", "one\ntwo"), ("b.html", "three")]


def test_layers_and_cards(spark):
    a = spark.createDataFrame([("1", 5.0)], "id string, x double")
    m = layers.merge_layers(spark.createDataFrame([("1",), ("2",)], "id string"), [(a.withColumnRenamed("x", "listing_x"), ["listing_x"])], "id", {"x": "listing_x", "id": "listing_x", "y": "none"})
    assert m.columns == ["id", "listing_x", "x"] and {r["id"]: r["x"] for r in m.collect()} == {"1": 5.0, "2": None}
    assert layers.union_all([a, a.drop("x")]).count() == 2
    assert layers.dictionary(spark.createDataFrame([("a", "b"), ("a", "b"), ("", "c"), (None, "d")], "p string, n string"), "p", "n").count() == 1


def test_checkpoint_folder_of_sessions(tmp_path):
    assert checkpoint_folder("hdfs:/shared", "spark://x:7077") == "hdfs:/shared" and os.path.isdir(checkpoint_folder(None, "local[4]"))
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            checkpoint_folder(None, master)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "out")
    for command in (["quality"], ["distances", "--lon", "112.42", "--lat", "30.65"], ["clusters", "--eps", "300"], ["history"]):
        assert cli.main([*command, "--tables", TABLES, "--out", out], spark) == 0
        name = command[0]
        assert spark.read.option("header", True).csv(f"{out}/{name}").count() > 10
        assert json.loads(spark.read.text(f"{out}/{name}_summary").first()[0])
    assert cli.main(["clusters", "--eps", "0", "--tables", TABLES, "--out", out], spark) == 2 and "positive" in capsys.readouterr().err
    with pytest.raises(SystemExit) as e:
        cli.main(["distances", "--tables", TABLES], spark)
    assert e.value.code == 2
    (tmp_path / "p.json").write_text(json.dumps({"page": 1, "total": 1, "page_size": 20, "list": [{"id": "7", "address": " Home ", "rent": "¥4,500"}, {"id": "x", "address": "no id"}]}))
    for dry in (["--dry-run"], []):
        assert cli.main(["ingest", "--captured", str(tmp_path), "--out", out, *dry], spark) == 0
    x, n = store.current(spark, f"{out}/listings", cli.LISTING_SCHEMA)
    assert n == 1 and [(r["source_listing_id"], r["title"], r["rent_price"]) for r in x.collect()] == [("7", "Home", 4500)]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_all_queries_with_sql_equal_it(spark):
    """The queries of this round's plans on the smallest tables."""
    import __spark_entry__ as e
    from rookery.plans import records, streams

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(TABLES):
        con.execute(f"create view {f[:-8]} as select * from '{TABLES}/{f}'")
    norm = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    for name in [*records.QUERIES, *streams.QUERIES]:
        df = e.queries()[name](spark, TABLES)
        cols = sorted(df.columns)
        rel = con.execute(e.oracle_sql()[name])
        names = [x[0] for x in rel.description]
        want = sorted(str([norm(r[names.index(c)]) for c in cols]) for r in rel.fetchall())
        assert sorted(str([norm(r[c]) for c in cols]) for r in df.collect()) == want, name
