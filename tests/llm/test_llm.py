"""Text and matching operators against brute force, planted cases and dirty input."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import names as N
from rookery.llm.address_parts import parse
from rookery.llm.addresses import building_classes, buildings, same_building
from rookery.llm import entities as E
from rookery.llm.entities import RADIUS, agreeing_pairs, calibration, entry_candidates, hamming_candidates, match_records, name_vector, rooms, scored
from rookery.llm.leakage import leaks, least_shared, shingle_length, shingles, word_hashes
from rookery.llm.mapping import edits, map_rows, read_values
from rookery.llm.packing import bucket_bounds, fill_plan, pack, token_counts
from rookery.llm.passages import aligned_errors, contains, longest_run, words
from rookery.llm.set_join import jaccard_join
from rookery.llm.sketches import BITS, decode, encode, merge, percentiles, sketch, value_error
from rookery.llm.textstats import STATISTICS, limit_scores, not_prose, outlier_scores, statistics_of, text_statistics

PAIRS = [("暮荫真栖苑二期", "muyinzhenqi yuan erqi"), ("暮荫真栖苑三期", "muyinzhenqi yuan sanqi"), ("远渡宁麦公寓", "yuanduningmai gongyu"), ("东渡怡菲真公寓", "dongduyifeizhen gongyu"), ("西渡怡菲真公寓", "xiduyifeizhen gongyu"), ("荷柳星家园", "heliuxing jiayuan"), ("萍竹月小区", "pingzhuyue xiaoqu"), ("葵罗苏里", "kuiluosu li")]
PINYIN = {"东": "dong", "西": "xi"} | N.learn_pinyin(PAIRS)


def test_names_and_pinyin():
    assert N.romanize("远渡宁麦", PINYIN) == "yuanduningmai"
    assert N.fold("　ＡＢ１​園 x ") == "ab1园 x"
    assert [N.han_number(x) for x in ("一百六十四", "四十", "十五", "二〇一", "一千二百零三")] == [164, 40, 15, 201, 1203]
    for typed, want in {"【暮荫真栖苑二期】": ("暮荫真栖苑", "二期"), "霖照路荷柳星家园": ("荷柳星家园", ""), "荷柳星家园近地铁": ("荷柳星家园", ""), "Heliuxing Estate II": ("heliuxing estate", "二期"), "荷湖区·荷柳星家园15号楼": ("荷柳星家园", ""), "荷柳星家园（业主直租）": ("荷柳星家园", ""), "": ("", "")}.items():
        assert N.clean_estate(typed) == want, typed


@pytest.mark.parametrize(
    "text",
    ["溪瑟屿市月梧区墨霞街道荷柳大道532弄86号304室", "荷柳大道五百三十二弄八十六号", "304室 86号 532弄 荷柳大道 月梧区", "荷柳大道532-86-304", "荷柳大道532弄/86/304", "Heliu Avenue 532 Nong 86 Hao 304", "Room 304, No. 86, Lane 532, Heliu Avenue, Yuewu District",
     "532 Lane Heliu Ave Bldg 86", "No.86 Ln 532 Heliu Ave, Yuewu", "Yuewu Dist., Heliu Ave, Lane 532, Building 86", "heliu dadao lane 532 no 86 rm 304", "荷柳大道５３２弄８６號樓", "荷柳大道 532弄 86# 304", "荷柳柳大道532弄86号【可短租】", "荷柳星家园(荷柳大道532弄)86号", "荷柳大道532弄内86号楼"],
)
def test_address_forms(text):
    p = parse(text, PINYIN)
    assert (p.road, p.kind, p.lane, p.building) == ("heliu", "dadao", 532, 86)


def test_same_building(spark):
    rows = [
        (1, "c", "荷柳大道532弄86号304室", "荷柳星家园"), (2, "c", "荷柳星家园86幢1001", None), (3, "c", "Room 1, No. 86, Lane 532, Heliu Avenue, X District", "x"), (4, "c", "荷柳大道532弄87号", "荷柳星家园"), (5, "d", "荷柳大道532弄86号", None),
        (6, "c", "荷柳 532弄86号", None), (7, "c", "月梧区荷柳大道", "荷柳星家园"), (8, "c", None, "荷柳星家园"), (9, "c", "", None), (10, "c", "柳荷大道532弄86号", "荷柳星家园"), (1, "c", "荷柳大道532弄86号304室", "荷柳星家园"), (11, "c", "萍竹月小区3号楼", None), (12, "c", "萍竹月小区 3栋", None), (13, "c", "长" * 5000, None),
    ]
    df = spark.createDataFrame(rows, "i long, city string, a string, e string").withColumn("id", F.lit("clash"))
    got = {tuple(r) for r in same_building(df, "i", "city", "a", "e", PINYIN).collect()}
    same = [1, 2, 3, 6, 10]
    assert got == {(a, b) for a in same for b in same if a < b} | {(11, 12)}
    assert buildings(df.limit(0), "i", "city", "a", "e", PINYIN).count() == 0
    links = {r["id"]: r["links"] for r in building_classes(df, "i", "city", "a", "e", PINYIN).collect()}
    assert links == dict.fromkeys(same, 4) | {4: 0, 5: 0, 11: 1, 12: 1}


def test_jaccard_join_equals_brute_force(spark):
    rnd = random.Random(2)
    sets = [sorted({f"t{min(int(rnd.expovariate(0.2)), 30)}" for _ in range(rnd.randrange(0, 8))}) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(sets)), "i int, tokens array<string>")
    for t in (0.5, 0.8):
        got = {(r["l_i"], r["r_k"]) for r in jaccard_join(df, df.withColumnRenamed("i", "k"), ["i"], ["k"], t).collect()}
        assert got == {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= t}
    with pytest.raises(ValueError):
        jaccard_join(df, df, ["i"], ["i"], 0)


def test_jaccard_join_of_hot_tokens(spark):
    rnd = random.Random(12)
    sets = [["hot", *{f"t{rnd.randrange(6)}" for _ in range(3)}] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "i int, tokens array<string>")
    got = [(r["l_i"], r["r_k"]) for r in jaccard_join(df, df.withColumnRenamed("i", "k"), ["i"], ["k"], 0.4, token_rows=7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.4}


def test_letters_are_read_in_one_pass():
    known = {"xi", "an", "xian", "fang", "fan", "gan", "mu"}
    assert N.segment("xianfang", known) == ["xian", "fang"] and N.segment("", known) == []
    assert N.segment("fangan", known) == ["fan", "gan"] or N.segment("fangan", known) == ["fang", "an"]
    assert N.segment("muqmu", known) == ["mu", "q", "mu"]
    assert N.segment("mu" * 1500, known) == ["mu"] * 1500


def test_pinyin_covers_every_character(spark):
    rows = [("荷柳家园", "heliu jiayuan")] * 3 + [(f"荷{c}家园", f"he{y} jiayuan") for c, y in (("柳", "liu"), ("星", "xing"), ("竹", "zhu"))] + [(None, "x"), ("长" * 300, "chang" * 300)]
    d = spark.createDataFrame(rows, "name string, name_pinyin string")
    got = N.pinyin_of(d, each=1)
    assert all(got[c] == y for c, y in (("荷", "he"), ("柳", "liu"), ("星", "xing"), ("竹", "zhu")))
    assert got == N.pinyin_of(d.orderBy(F.desc("name")), each=1)


def test_edits():
    assert [edits(list(a), list(b)) for a, b in (("abcd", "abcd"), ("abcd", "acbd"), ("abcd", "abd"), ("abcd", "abxd"), ("", "ab"), ("abcd", "abccd"))] == [0, 1, 1, 1, 2, 1]


def _ref(spark):
    return spark.createDataFrame([("estate", i, n, 1 if n[0] == "东" else 2, "d") for i, (n, _) in enumerate(PAIRS)], "kind string, ref_id long, name string, parent long, district string")


CASES = {
    "荷柳星家园": 5, "荷星柳家园": 5, "荷柳家园": 5, "荷柳柳星家园": 5, "荷?星家园": 5, "荷柳星": 5, "HELIUXING HOMES": 5, "heliuxingjiayuan": 5, "荷柳星家園近地铁": 5, "葵罗路萍竹月小区": 6, "暮荫真栖苑２期": 0, "暮荫真栖苑一期": -1, "荷柳星大厦": -1, "月星荷家园": -1, "test123": -1, "-": -1, "": -1,
}


@pytest.mark.parametrize("way", ["jaccard", "hamming"])
def test_map_rows(spark, way):
    rows = [(i, "estate", v, "d") for i, v in enumerate(CASES)] + [(100, "estate", None, "d"), (None, "estate", "荷柳星家园", "d"), (0, "estate", "荷柳星家园", "d"), (101, "estate", "长" * 3000, "d"), (102, "estate", "mu" * 1500, "d"), (103, "estate", "heliuxing" * 333 + " homes", "d")]
    df = spark.createDataFrame(rows, "id long, kind string, value string, district string").withColumn("ref_name", F.lit(1))
    more = {"candidates": entry_candidates} if way == "hamming" else {}
    got = {r["id"]: r["ref_id"] for r in map_rows(df, _ref(spark), PINYIN, ("district",), **more).collect()}
    assert got == dict(enumerate(CASES.values())) | {101: -1, 102: -1, 103: -1}
    tied = spark.createDataFrame([(1, "estate", "渡怡菲真公寓", "d")], "id long, kind string, value string, district string")
    assert map_rows(tied, _ref(spark), PINYIN, ("district",)).first()["ref_id"] == 3
    assert map_rows(df.limit(0), _ref(spark), PINYIN, ("district",)).count() == 0


def test_hamming_candidates_are_exact(spark):
    rnd = random.Random(3)
    rows = [("k", f"v{i}", 0, sorted({f"t{rnd.randrange(25)}" for _ in range(rnd.randrange(2, 5))})) for i in range(150)]
    a = spark.createDataFrame(rows, "kind string, value string, variant int, syllables array<string>")
    b = a.select("kind", F.substring("value", 2, 9).cast("long").alias("ref_id"), "variant", "syllables")
    got = [(r["value"], r["ref_id"]) for r in hamming_candidates(a, b, least=0.0).collect()]
    v = {r["value"]: (r["x"]["lo"] & (2**64 - 1)) | (r["x"]["hi"] & (2**64 - 1)) << 64 for r in a.select("value", name_vector("syllables").alias("x")).collect()}
    # every vector is an entry's here, so each finds its equals only; without them, all in the radius
    assert len(got) == len(set(got)) and set(got) == {(x, int(y[1:])) for x in v for y in v if v[x] == v[y]}
    others = a.withColumn("syllables", F.array_append("syllables", F.concat(F.lit("own"), "value")))
    u = {r["value"]: (r["x"]["lo"] & (2**64 - 1)) | (r["x"]["hi"] & (2**64 - 1)) << 64 for r in others.select("value", name_vector("syllables").alias("x")).collect()}
    want = {(x, int(y[1:])) for x in u for y in v if 0 < bin(u[x] ^ v[y]).count("1") <= RADIUS} | {(x, int(y[1:])) for x in u for y in v if u[x] == v[y]}
    alike = {x for x in u for y in v if u[x] == v[y]}
    want = {(x, y) for x, y in want if x not in alike or u[x] == v[f"v{y}"]}
    for rows_a_block in (E.PLACE_ROWS, 2):
        E_rows, E.PLACE_ROWS = E.PLACE_ROWS, rows_a_block
        got = [(r["value"], r["ref_id"]) for r in hamming_candidates(others, b, least=0.0).collect()]
        E.PLACE_ROWS = E_rows
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    with pytest.raises(ValueError):
        hamming_candidates(a, b, E.NAME_CHUNKS)


def records(rnd, n, key, areas=(None, 50.0, 51.9, 52.5, 80.0), rents=(None, 3000.0, 3230.0, 3300.0)):
    return [(i, "c", rnd.choice([1, 2]), rnd.choice([None, 1, 2]), rnd.choice(areas), rnd.choice(rents)) for i in range(n)]


def fields(k):
    return f"{k} long, city string, ref_id int, rooms int, area double, rent double"


@pytest.mark.parametrize("rows_a_block", [20_000, 4])
def test_agreeing_pairs_equal_brute_force(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(E, "PLACE_ROWS", rows_a_block)
    rnd = random.Random(4)
    left, right = records(rnd, 60, "lid"), records(rnd, 60, "rid")
    a, b = spark.createDataFrame(left, fields("lid")), spark.createDataFrame(right, fields("rid"))
    got = [(r["lid"], r["rid"]) for r in scored(agreeing_pairs(a, b, ["city", "ref_id"])).collect()]

    def ok(x, y):
        known = [(k, p, q) for k, (p, q) in enumerate(zip(x[3:], y[3:])) if p is not None and q is not None]
        return x[1:3] == y[1:3] and len(known) >= 2 and all(p == q if k == 0 else max(p, q) / min(p, q) <= (1.04 if k == 1 else 1.08) for k, p, q in known)

    assert sorted(got) == sorted((x[0], y[0]) for x in left for y in right if ok(x, y))
    m = match_records(a, b, ["city", "ref_id"])
    assert m.count() == len(got) and m.where("confidence is null or confidence < 0 or confidence > 1").count() == 0
    assert match_records(a.limit(0), b, ["city", "ref_id"]).count() == 0


def test_pairs_are_compared_in_compiled_code(spark):
    """The search and the scores fit the methods that Spark compiles; it stops here where it would go on without."""
    rnd = random.Random(7)
    a, b = spark.createDataFrame(records(rnd, 40, "lid"), fields("lid")), spark.createDataFrame(records(rnd, 40, "rid"), fields("rid"))
    conf = {"spark.sql.codegen.fallback": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert scored(agreeing_pairs(a, b.withColumn("chance", F.lit(False)), ["city", "ref_id"])).select("lid", "rid", "chance", "have", "score").count() > 0
        assert scored(agreeing_pairs(a, b, ["city", "ref_id"])).where("score < 2").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_search_is_exact_in_the_radius(spark):
    """All numbers in two ranges of each other are found, and the Dice tells apart what lies within the ratio."""
    rnd = random.Random(5)
    num = lambda: math.exp(rnd.uniform(math.log(3), math.log(40_000)))
    left = [(i, "c", 1, 2, num(), num()) for i in range(300)]
    right = [(i, "c", 1, 2, left[i][4] * math.exp(rnd.uniform(-0.12, 0.12)), left[i][5] * math.exp(rnd.uniform(-0.2, 0.2))) for i in range(300)]
    idx = lambda x, ratio: math.floor(math.log(x) * (E.STEPS / math.log(ratio)))
    shifts = lambda x, y: (abs(idx(x[4], E.AREA_RATIO) // E.STEPS - idx(y[4], E.AREA_RATIO) // E.STEPS), abs(idx(x[5], E.RENT_RATIO) // E.STEPS - idx(y[5], E.RENT_RATIO) // E.STEPS))
    want = {(x[0], y[0]) for x in left for y in right if sum(shifts(x, y)) <= 2}
    p = agreeing_pairs(spark.createDataFrame(left, fields("lid")), spark.createDataFrame(right, fields("rid")), ["city", "ref_id"]).collect()
    assert len(p) == len(want) and {(r["lid"], r["rid"]) for r in p} == want and len(want) > 100
    for r in p:
        d = abs(idx(left[r["lid"]][4], E.AREA_RATIO) - idx(right[r["rid"]][4], E.AREA_RATIO))
        assert r["area"] == pytest.approx((max(0, E.FINE - d) + max(0, E.FINE - 64 + d)) / E.FINE)  # around the ring of 64
        assert (r["area"] >= E.FLOORS["area"] - 1e-9) == (d <= E.STEPS)
    for have in E.PATTERNS:  # one field that disagrees costs more than all others can lack
        names = ["place", *[f for f, b in E.FIELD_BITS.items() if have & b]]
        assert all(1 - E.WEIGHTS[f] / sum(E.WEIGHTS[g] for g in names) < E.least_score(have) - 1e-9 for f in names)


def test_confidence_on_planted_pairs(spark):
    """Homes with a noisy double, among strangers of crowded and of empty places: confidence is near the share that is right."""
    rnd = random.Random(6)
    left, right = [], []
    for i in range(9000):
        place = rnd.randrange(10) if rnd.random() < 0.5 else 10 + rnd.randrange(1500)
        rooms_, area, rent = rnd.randrange(1, 4), rnd.uniform(30, 120), rnd.uniform(2000, 9000)
        left.append((i, "c", place, rooms_, area, rent))
        if i % 2:
            right.append((i, "c", place, None if rnd.random() < 0.2 else rooms_, area * rnd.uniform(0.97, 1.03), rent * rnd.uniform(0.95, 1.05)))
        else:
            right.append((i, "c", place, rnd.randrange(1, 4), rnd.uniform(30, 120), rnd.uniform(2000, 9000)))
    m = match_records(spark.createDataFrame(left, fields("lid")), spark.createDataFrame(right, fields("rid")), ["city", "ref_id"]).collect()
    assert {r["lid"] for r in m if r["lid"] == r["rid"]} >= {i for i in range(1, 9000, 2)}
    by = {}
    for r in m:
        by.setdefault(min(int(r["confidence"] * 5), 4), []).append((r["confidence"], r["lid"] == r["rid"] and r["lid"] % 2 == 1))
    for rows in by.values():
        if len(rows) >= 100:
            assert abs(sum(c for c, _ in rows) / len(rows) - sum(t for _, t in rows) / len(rows)) < 0.12
    assert max(by) == 4


def test_calibration_and_rooms(spark):
    cal = calibration({(7, 40): 100, (7, 34): 10}, {(7, 34): 9})
    assert cal[7, 40] > 0.99 > cal[7, 34]
    x = spark.createDataFrame([("２室１厅",), ("一室户",), ("studio",), ("3R1L2B",), ("两房",), ("?",), (None,)], "layout string").select(rooms("layout").alias("r")).collect()
    assert [r["r"] for r in x] == [2, 1, 1, 3, 2, None, None]


def test_leaks_against_planted_passages(spark, monkeypatch):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    items = {i: [rnd.choice(vocab) for _ in range(100)] for i in range(8)}
    noise = lambda n: [rnd.choice(vocab) for _ in range(n)]

    def changed(ws, step=10):
        return [("zzz" if k % step == step - 1 else w) for k, w in enumerate(ws)]

    docs, want = {}, set()
    docs[0], _ = " ".join(noise(50) + items[0][20:70] + noise(40)), want.add((0, 0))
    docs[1], _ = " ".join(noise(500) + changed(items[1][10:60])).upper(), want.add((1, 1))
    docs[2] = " ".join(items[2][:38] + noise(60))  # too short
    docs[3] = " ".join(rnd.sample(items[3], 100))  # another order
    docs[4], _ = "<p>" + "</p>\n\n<b>".join(items[4][:60]) + "!!", want.add((4, 4))
    gone = [w for k, w in enumerate(items[5][:60]) if k % 15 != 7]
    docs[5], _ = "　".join(gone), want.add((5, 5))
    docs[6], docs[7] = "", None
    docs[8] = " ".join(changed(items[6][:60], 4))  # too many changes
    docs[9], _ = " ".join(noise(20_000) + items[7] + noise(20_000)), want.add((9, 7))
    docs[10], _ = docs[0], want.add((10, 0))
    d = spark.createDataFrame(list(docs.items()) + [(0, docs[0]), (None, docs[0])], "doc_id long, text string").withColumn("item", F.lit("clash"))
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(99, None), (98, ""), (None, "x")], "item_id long, text string")
    assert {tuple(r) for r in leaks(d, "doc_id", "text", i, "item_id", "text").collect()} == want
    # hot shingles in blocks, a full filter, and texts that are shuffled
    for name, value in (("SHINGLE_ROWS", 1), ("BLOOM_BITS", 1 << 6), ("BLOOM_EACH", 0), ("FEW_TEXTS", 0), ("ITEM_MEMORY", 1)):
        monkeypatch.setattr(f"rookery.llm.leakage.{name}", value)
    assert {tuple(r) for r in leaks(d, "doc_id", "text", i, "item_id", "text").collect()} == want
    assert leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0


def spread_changes(run, count):
    """The run with so many words changed, as far apart as can be: then the fewest shingles survive."""
    at = {round((j + 1) * len(run) / (count + 1)) for j in range(count)}
    return [f"changed{i}" if i in at else w for i, w in enumerate(run)]


def test_least_shared_against_brute_force():
    for n in range(66, 214):
        item = [f"w{i}" for i in range(n)]
        own = shingles(word_hashes(" ".join(item)))
        left = [int(np.isin(own, shingles(word_hashes(" ".join(spread_changes(item[:m], m // 10))))).sum()) for m in range(-(-4 * n // 10), n + 1)]
        assert min(left) == least_shared(n), n


def test_leaks_with_one_change_more_in_a_longer_run(spark):
    cases = {66: 30, 72: 30, 96: 40, 147: 60, 199: 80}  # words of the item, and of the run in the text
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in cases}
    docs = [(n, " ".join(["before"] * 9 + spread_changes(items[n][5 : 5 + run], run // 10) + ["after"] * 9)) for n, run in cases.items()]
    # the same runs with too many changes
    docs += [(1000 * c + n, " ".join(spread_changes(items[n][5 : 5 + run], run // 5))) for n, run in cases.items() for c in range(1, 4)]
    i = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {tuple(r) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {(n, n) for n in cases}


def test_leaks_of_short_items_equal_brute_force(spark):
    assert [shingle_length(n) for n in (1, 2, 3, 5, 6, 7, 8, 10, 11, 12, 13, 100)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5, 5]
    rnd = random.Random(8)
    items = {n: [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)] for n in range(1, 13)}
    docs = {k: [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(0, 60))] for k in range(60)}
    for n, w in items.items():  # pieces of just enough and of one too few words
        m = -(-4 * n // 10)
        docs[100 + n], docs[200 + n] = ["#x", *w[n - m :], "#y"], w[: m - 1] + ["#z"]
    # so few words allow no change that leaves less than enough words in a row beside it
    grams = lambda w, m: {tuple(w[j : j + m]) for j in range(len(w) - m + 1)}
    clean = {k: [x.strip("#") for x in w] for k, w in docs.items()}
    want = {(k, n) for k, d in clean.items() for n, w in items.items() if grams(w, -(-4 * n // 10)) & grams(d, -(-4 * n // 10))}
    frame = lambda x, c: spark.createDataFrame([(k, " ".join(w)) for k, w in x.items()], f"{c} long, text string")
    assert {tuple(r) for r in leaks(frame(docs, "doc_id"), "doc_id", "text", frame(items, "item_id"), "item_id", "text").collect()} == want


def test_runs_and_alignment():
    rnd = random.Random(7)
    for _ in range(200):
        e = np.array([rnd.random() < 0.15 for _ in range(rnd.randrange(1, 60))], int)
        want = max((b - a for a in range(len(e)) for b in range(a + 1, len(e) + 1) if e[a] == e[b - 1] == 0 and e[a:b].sum() <= 0.1 * (b - a) + 1e-9), default=0)
        assert longest_run(e, 0.1) == want
    item = np.arange(1, 41, dtype=np.uint64)
    window = np.concatenate([np.zeros(12, np.uint64), np.delete(item, 10), np.zeros(12, np.uint64)])
    assert aligned_errors(item, window, 12).sum() == 1
    assert words("<b>Ａb-c&amp;D</b> 12号楼") == ["ab", "c", "d", "12", "号", "楼"]
    assert words("第 ９ 8\n0 份 12 3") == ["第", "980", "份", "12", "3"] and words(f'<img src="data:{"x" * 2000}">a') == ["a"]
    # more words added than replaced words could shift by, spread over a long run
    long = np.arange(1, 301, dtype=np.uint64)
    text = np.concatenate([np.concatenate([long[k : k + 12], [np.uint64(9999)]]) for k in range(0, 300, 12)])
    assert contains(long, text, shingles(long), shingles(text), [0], 0.9, 0.1, 1)
    assert least_shared(100) == 16 and least_shared(5) == 1
    assert len(shingles(word_hashes("a b c d"))) == 0


PROSE = "We liked the window, though the hidden shelf was cleaned two weeks ago. It is a quiet place near the canal."
JUNK = ["a / b", "- odd gate\n- dry lamp\n- old sofa\n- big sink", "★★★ ||| $$$", "WRbQBzx0WTgM556OJfc6HrgTQGq", "", "lamp lamp sofa lamp sofa lamp sofa sofa", "水龙头: —\n地毯: 老旧\n厨房: 精致", None, "\n\n", "APP | Log in | Sell | 下一页 | Log in | Log in | Help | Log in"]


def test_not_prose(spark):
    good = [PROSE, "签字之前一定要问清楚押金，直到新钥匙送到。", "guard: is the lamp by the gate as old as they told us?\ncook: it is not, but the noise stayed.", PROSE + "\n- gate\n- lamp", "对方多要了2百块发票 邻居之前从来没提过 楼梯坏了以后"] * 6
    rows = list(enumerate(good)) + [(1000 + i, t) for i, t in enumerate(JUNK)] + [(0, good[0]), (None, "x")]
    df = spark.createDataFrame(rows, "k long, text string").withColumn("lang", F.lit("xx"))
    assert {r["id"] for r in not_prose(df, "k", "text").collect()} == {1000 + i for i in range(len(JUNK))}
    assert not_prose(df.limit(0), "k", "text").count() == 0


def test_not_prose_whatever_the_mix(spark):
    junk = ["- odd gate\n- dry lamp\n- old sofa\n- big sink"] * 40 + [f"- gate {i}\n- lamp {i} x {i}\n- sofa {i}" for i in range(20)]
    rows = list(enumerate([PROSE] * 10)) + [(1000 + i, t) for i, t in enumerate(junk)]
    df = spark.createDataFrame(rows, "k long, text string")
    assert {r["id"] for r in not_prose(df, "k", "text").collect()} == {1000 + i for i in range(len(junk))}
    assert {r["id"] for r in not_prose(df.where("k >= 1000"), "k", "text").collect()} == {1000 + i for i in range(len(junk))}
    assert not_prose(df.where("k < 1000"), "k", "text").count() == 0


def test_scores_are_exact_ranks(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["en", "zh"]), rnd.randrange(9), *[round(rnd.random(), 1) for _ in range(5)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, lang string, " + ", ".join(f"{k} {'long' if k == 'words' else 'double'}" for k in STATISTICS))
    got = {r["id"]: r["score"] for r in outlier_scores(df).collect()}
    for r in rows:
        same = [x for x in rows if x[1] == r[1]]
        s = 0.0
        for k, tail in enumerate(STATISTICS.values()):
            lo, hi = (sum(f(x[2 + k], r[2 + k]) for x in same) / len(same) for f in (lambda a, b: a <= b, lambda a, b: a >= b))
            s -= math.log({"low": lo, "high": hi, "both": min(1.0, 2 * min(lo, hi))}[tail])
        assert got[r[0]] == pytest.approx(s)
    assert statistics_of("") == ("none", 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert text_statistics(spark.createDataFrame([(1, "x" * 300_000)], "i long, t string"), "i", "t").first()["mean_word_len"] == 300_000


def test_limits_are_ranks(spark):
    rnd = random.Random(13)
    rows = [(i, "en" if i < 200 else "zh", rnd.randrange(3), 1.0, 0.0, 0.0, round(rnd.random(), 2), rnd.choice([0.0, 0.3, 0.5, 0.51, 1.0])) for i in range(300)]
    rows += [(1000 + i, "none", 0, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(3)] + [(2000 + i, "xx", 5, 1.0, 0.0, 0.0, 0.9, 0.9) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, lang string, " + ", ".join(f"{k} {'long' if k == 'words' else 'double'}" for k in STATISTICS))
    got = {r["id"]: r["beyond"] for r in limit_scores(df).collect()}
    at = list(STATISTICS)
    for r in rows:
        same = sorted(x[2 + at.index("common_share")] for x in rows if x[1] == r[1])
        usual = same[math.ceil(0.9 * len(same)) - 1]
        over = r[2] <= 0 or r[2 + at.index("running_share")] <= 0.5 or r[2 + at.index("common_share")] <= usual / 4
        assert (got[r[0]] >= 1 - 1e-9) == over, r
    assert {r["id"] for r in limit_scores(df, 1.0).collect()} == {i for i, b in got.items() if b >= 1 - 1e-9}
    assert limit_scores(df.limit(0)).count() == 0


def test_packing(spark):
    rnd = random.Random(9)
    sizes = [(i, int(rnd.expovariate(1 / 60)) + 1) for i in range(400)] + [(900, 250), (901, 100), (902, 0), (903, None), (None, 5), (0, None)]
    df = spark.createDataFrame(sizes + sizes[:5], "id long, tokens long").withColumn("container", F.lit(0))
    for k in (4, 64):
        got = pack(df.select("id", "tokens"), 100, k).collect()
        used, per = Counter(), Counter()
        for r in got:
            used[r["container"]] += r["tokens"]
            per[r["id"]] += r["tokens"]
        assert all(v <= 100 for v in used.values()) and all(100 - used[r["container"]] == r["unused"] for r in got)
        assert per == Counter({i: n for i, n in sizes if i is not None and n})
        whole = Counter(r["id"] for r in got)
        assert all(whole[i] == math.ceil(n / 100) for i, n in sizes if i is not None and n)
    assert sum(used.values()) / (100 * len(used)) > 0.97
    assert pack(df.select("id", "tokens").limit(0)).count() == 0


def test_bucket_bounds_are_optimal():
    h = {1: 5, 2: 1, 4: 7, 5: 2, 9: 1, 10: 4}
    cost = lambda bs: sum(n * (min(b for b in bs if b >= x) - x) for x, n in h.items())
    for k in (1, 2, 3, 6):
        best = min(cost(c) for c in itertools.combinations(h, k) if max(c) == 10)
        assert cost(bucket_bounds(h, 10, k)) == best
    plan = fill_plan([3, 7], [5, 2], 10)
    assert sum(t * m.get(1, 0) for t, m in plan) == 2 and sum(t * m.get(0, 0) for t, m in plan) == 5


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "房" * 20_000)], "i long, t string")
    n = {r["id"]: r["tokens"] for r in token_counts(df, "i", "t").collect()}
    assert 2 <= n[1] <= 3 and n[2] == n[3] == 0 and n[4] > 1000


def test_sketches(spark):
    rnd = random.Random(10)
    rows = [(rnd.choice(["a", "b", None]), d, float(int(rnd.lognormvariate(8, 1)))) for d in range(4) for _ in range(1500)]
    bad = [("a", 0, None), ("a", 0, float("nan")), ("a", 0, float("inf")), ("z", 1, None)]
    df = spark.createDataFrame(rows + bad, "g string, d int, v double").withColumn("w", F.lit(1))
    daily = sketch(df, ["g", "d"], ["v"])
    got = percentiles(merge(daily, ["g"]), ["g"]).collect()
    assert {r["g"] for r in got} == {"a", "b", None}
    for r in got:
        v = np.sort([x for g, _, x in rows if g == r["g"]])
        assert r["n"] == len(v)
        lo, hi = np.searchsorted(v, r["value"] * (1 - r["value_error"])), np.searchsorted(v, r["value"] * (1 + r["value_error"]), side="right")
        k = math.ceil(r["q"] * len(v))
        off = 0 if lo < k <= hi else min(abs(lo + 1 - k), abs(hi - k))
        assert off <= r["rank_error"] * len(v) + 1
    # days taken away again leave what the other days give, and a whole that is deleted gives nothing
    minus = df.where("d > 1").withColumn("m", F.lit(-1))
    left = merge(daily.unionByName(sketch(minus, ["g", "d"], ["v"], "m")), ["g"]).where("c <> 0")
    only = merge(sketch(df.where("d <= 1"), ["g", "d"], ["v"]), ["g"]).where("c <> 0")
    assert left.exceptAll(only).count() == 0 and only.exceptAll(left).count() == 0
    assert percentiles(merge(daily.unionByName(daily.withColumn("c", -F.col("c"))), ["g"]), ["g"]).count() == 0
    assert percentiles(sketch(df.limit(0), ["g"], ["v"]), ["g"]).count() == 0
    far = (-1.7e308, -1e30, -5.0, -1e-3, -5e-324, 0.0, 5e-324, 1e-300, 1e-19, 1e-18, 1e-3, 1.0, 4500.0, 1e18, 1e19, 1.7e308)
    codes = spark.createDataFrame([(x,) for x in far], "x double").select("x", encode(F.col("x")).alias("c")).collect()
    assert [r["c"] for r in codes] == sorted(r["c"] for r in codes)
    assert all(0 <= r["c"] < 1 << BITS and (r["x"] == decode(r["c"]) == 0 or abs(decode(r["c"]) / r["x"] - 1) <= value_error(r["c"]) + 1e-12 or abs(r["x"]) < 1e-307) for r in codes)
    assert all(value_error(r["c"]) < 1e-4 for r in codes if 1e-18 <= abs(r["x"]) <= 1e18)


def test_counts_become_sketches_when_they_grow(spark, monkeypatch):
    rnd = random.Random(11)
    monkeypatch.setattr("rookery.llm.sketches.FEW", 50)
    df = spark.createDataFrame([("a", d, rnd.uniform(1, 9)) for d in range(20) for _ in range(40)] + [("b", 0, float(x)) for x in range(1, 11)], "g string, d int, v double")
    daily = sketch(df, ["g", "d"], ["v"])
    assert {r["level"] for r in daily.select("level").distinct().collect()} == {-1}
    whole = merge(daily, ["g"])
    assert whole.where("g = 'a' and level = -1").count() == 0 and whole.where("g = 'b' and level <> -1").count() == 0
    # the same counters, whichever way they were merged
    again = merge(merge(daily.where("d < 10"), ["g"]).unionByName(merge(daily.where("d >= 10"), ["g"])), ["g"])
    assert whole.exceptAll(again).count() == 0 and again.exceptAll(whole).count() == 0
    got = {(r["g"], r["q"]): r for r in percentiles(whole, ["g"]).collect()}
    assert got["b", 0.5]["rank_error"] == 0 and got["b", 0.5]["value"] == pytest.approx(5, rel=1e-4) and got["a", 0.5]["rank_error"] > 0


def test_read_values_keeps_kinds_apart(spark):
    df = spark.createDataFrame([("estate", "荷柳里"), ("subdistrict", "荷柳镇")], "kind string, value string")
    t = {r["kind"]: set(r["tokens"]) for r in read_values(df, PINYIN).collect()}
    assert not t["estate"] & t["subdistrict"]
