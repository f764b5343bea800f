"""History of changing attributes as a bitemporal ledger: valid time and recorded time, nothing overwritten.

Every observation of an entity states values from its valid time on. Observations arrive in recorded order. When one
arrives, the interval that holds its valid time, [before, after), is superseded: its row gets a recorded end, and two
rows follow it, [before, here) with the old values and [here, after) with the new. Which intervals split is found by
a sweep over valid time with the nearest earlier-recorded observation to the left (before) and to the right (after);
the row that a later arrival splits in turn is found from the same two neighbours (they form a Cartesian tree).

An entity with very many observations is cut into chunks of valid time. Chunks are swept in different tasks, and the
observations whose neighbours lie in another chunk are settled by a look-up in the minima of the chunks and an as-of look-up
in the chunk found, in blocks, so that no entity has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rookery.operators.blocks import spread_join, with_blocks
from rookery.session import cut

HOT_ROWS = 100_000
CHUNK_ROWS = 50_000
#: Chunks of one entity, at most: an entity of more than HOT_CHUNKS * CHUNK_ROWS rows has larger chunks, a thousandth of it.
HOT_CHUNKS = 1024
#: Recorded order of an observation whose recorded time is null: after all others.
LAST_RUN = (1 << 62) - 1


def _nearest(rank: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
    """Index of the nearest element to the left (step -1) or right (1) of lower rank in the same group, or -1."""
    n = len(rank)
    at = np.arange(n) + step
    at[edge] = -1
    while True:
        bad = np.nonzero((at >= 0) & (rank[at] > rank))[0]
        if not len(bad):
            return at
        at[bad] = at[at[bad]]


def _sweep_table(t: pa.Table, keys: list[str], values: list[str]) -> pa.RecordBatch | None:
    n = t.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for c in [*keys, "_c"]:
        col = t[c].combine_chunks()
        differ = pc.not_equal(col.slice(1), col.slice(0, n - 1)).fill_null(False).to_numpy(zero_copy_only=False)
        nulls = col.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differ.astype(bool) | (nulls[1:] != nulls[:-1])
    last = np.roll(new, -1)
    last[-1] = True
    v, run = t["v"].to_numpy(), t["run"].to_numpy()
    rank = np.empty(n, np.int64)
    rank[np.lexsort((v, run))] = np.arange(n)
    pred, succ = _nearest(rank, new, -1), _nearest(rank, last, 1)
    have_p, have_s = pred >= 0, succ >= 0
    # the neighbour recorded later is the parent in the tree; its row on this side is the one that is split here
    of_pred = have_p & (~have_s | (rank[pred] > rank[succ]))
    of_succ = have_s & ~of_pred
    left_child, right_child = np.full(n, -1), np.full(n, -1)
    right_child[pred[of_pred]] = np.nonzero(of_pred)[0]
    left_child[succ[of_succ]] = np.nonzero(of_succ)[0]
    out = {c: t[c].combine_chunks() for c in [*keys, "_c", "_hot", "v", "run", *values]}

    def taken(col: pa.Array, index: np.ndarray) -> pa.Array:
        return col.take(pa.array(index, pa.int64(), mask=index < 0))

    for name, index in (("pred", pred), ("succ", succ), ("lc", left_child), ("rc", right_child)):
        for c in ("v", "run"):
            out[f"{name}_{c}"] = taken(out[c], index)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    for c in values:
        out[f"pred_{c}"] = taken(out[c], pred)
        known = np.maximum.accumulate(np.where(out[c].is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
        known = np.where(known >= start, known, -1)
        before = np.where(new, -1, np.roll(known, 1))
        out[f"st_{c}"], out[f"pv_{c}"] = taken(out[c], known), taken(out[c], before)
    out["_first"] = pa.array(new)
    return pa.RecordBatch.from_pydict(out)


def _sweep(keys: list[str], values: list[str], rows: int = 100_000):
    """Over partitions sorted by keys, chunk and valid time; only whole chunks are swept, a chunk is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def tail(t: pa.Table) -> int:
            """Where the last chunk of a table starts."""
            n, same = t.num_rows, np.ones(t.num_rows, bool)
            for c in [*keys, "_c"]:
                col, x = t[c].combine_chunks(), t[c][n - 1]
                same &= (pc.equal(col, x).fill_null(False) if x.is_valid else col.is_null()).to_numpy(zero_copy_only=False).astype(bool)
            other = np.nonzero(~same)[0]
            return int(other[-1]) + 1 if len(other) else 0

        size = 0
        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]))
                size += b.num_rows
            if size >= rows:
                t = pa.concat_tables(held).combine_chunks()
                k = tail(t)
                if k:
                    yield _sweep_table(t.slice(0, k), keys, values)
                held, size = [t.slice(k)], t.num_rows - k
                if not k:
                    rows_now = size
                    size = rows_now if rows_now < rows else rows - 10_000  # look again after another batch
        if held:
            t = pa.concat_tables(held).combine_chunks()
            if t.num_rows:
                yield _sweep_table(t, keys, values)

    return run


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _across(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Settle, for entities of several chunks, the neighbours that lie in another chunk, and from them the children."""
    rows = cut(rows)
    seq = F.struct("run", "v")
    chunks = rows.groupBy(*keys, "_c").agg(F.min(seq).alias("least"), *[F.max_by(f"st_{c}", "v").alias(f"end_{c}") for c in values])
    w = Window.partitionBy(*keys).orderBy("_c")  # one row per chunk of an entity
    # the minima of the other chunks of an entity, of which there are HOT_CHUNKS at most, the nearest first
    each = F.struct("least", F.col("_c").alias("c"))
    before = F.reverse(F.collect_list(each).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    after = F.collect_list(each).over(w.rowsBetween(1, Window.unboundedFollowing))
    chunks = cut(chunks.select(*keys, "_c", "least", F.min("least").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("later"), (F.row_number().over(w) == 1).alias("opens"), *[F.last(f"end_{c}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"in_{c}") for c in values], before.alias("before"), after.alias("after")))
    more = ["later", "opens", *[f"in_{c}" for c in values]]
    r = rows.alias("r").join(chunks.alias("k"), _same("r", "k", keys) & (F.col("r._c") == F.col("k._c"))).select("r.*", *[f"k.{c}" for c in more])
    r = r.withColumns({f"{p}_{c}": F.coalesce(f"{p}_{c}", f"in_{c}") for p in ("st", "pv") for c in values} | {"_first": F.col("_first") & F.col("opens")}).drop("opens", *[f"in_{c}" for c in values])
    r = cut(r)

    def settle(r: DataFrame, side: str) -> DataFrame:
        open_ = F.col("pred_v").isNull() if side == "pred" else F.col("succ_v").isNull() & F.col("later").isNotNull() & (F.col("later") < seq)
        q = r.where(open_).select(*keys, "_c", "run", "v")
        # the nearest chunk beyond with an earlier record, out of the chunks' minima, the nearest first
        beyond = chunks.select(*keys, "_c", F.col("before" if side == "pred" else "after").alias("_beyond"))
        hit = F.get(F.filter("k._beyond", lambda x: x["least"] < F.struct("q.run", "q.v")), F.lit(0))["c"]
        q = q.alias("q").join(beyond.alias("k"), _same("q", "k", keys) & (F.col("q._c") == F.col("k._c"))).select(*[F.col(f"q.{k}").alias(k) for k in keys], hit.alias("_c"), "q.run", "q.v").where("_c is not null")
        q = cut(with_blocks(q, [*keys, "_c"], "v", CHUNK_ROWS))
        # in that chunk the neighbour is the latest record before this one of those that nothing earlier in the chunk hides
        seen = rows.where(F.col("succ_v" if side == "pred" else "pred_v").isNull())
        big = q.where("_blocks > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_c").alias("_kc"), F.col("_blocks").alias("_nb")).distinct()
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_c") == F.col("_kc")]
        each = F.explode(F.sequence(F.lit(0), F.coalesce("_nb", F.lit(1)) - 1)).alias("_block")
        found = F.struct("v", "run", *values)
        seen = seen.select(*keys, "_c", "run", "v", found.alias("n")).join(big, on, "left").select(*keys, "_c", "run", "v", "n", each)
        both = q.select(*keys, "_c", "run", "v", F.lit(None).cast(seen.schema["n"].dataType).alias("n"), "_block", F.lit(True).alias("_asks")).unionByName(seen.withColumn("_asks", F.lit(False)))
        w = Window.partitionBy(*keys, "_c", "_block").orderBy("run", "v").rowsBetween(Window.unboundedPreceding, -1)
        near = both.withColumn("n", F.last("n", ignorenulls=True).over(w)).where("_asks and n is not null").select(*keys, F.col("v").alias("qv"), "n")
        more = ["v", "run", *(values if side == "pred" else [])]
        j = r.alias("r").join(near.alias("n"), _same("r", "n", keys) & (F.col("r.v") == F.col("n.qv")), "left")
        new = {f"{side}_{c}": F.coalesce(F.col(f"r.{side}_{c}"), F.when(F.col(f"r.{side}_v").isNull(), F.col(f"n.n.{c}"))) for c in more}
        return j.select(*[new[c].alias(c) if c in new else F.col(f"r.{c}") for c in r.columns])

    r = cut(settle(settle(r, "pred"), "succ"))
    of_pred = F.col("pred_v").isNotNull() & (F.col("succ_v").isNull() | (F.struct("pred_run", "pred_v") > F.struct("succ_run", "succ_v")))
    child = r.where("pred_v is not null or succ_v is not null").select(*keys, F.when(of_pred, F.col("pred_v")).otherwise(F.col("succ_v")).alias("pv"), of_pred.alias("right"), "v", "run")
    child = child.groupBy(*keys, "pv").agg(*[F.max(F.when(F.col("right") == F.lit(s), F.col(c))).alias(f"{n}_{c}") for s, n in ((False, "lc"), (True, "rc")) for c in ("v", "run")])
    kids = ["lc_v", "lc_run", "rc_v", "rc_run"]
    j = r.drop(*kids).alias("r").join(child.alias("c"), _same("r", "c", keys) & (F.col("r.v") == F.col("c.pv")), "left")
    return j.select(*[F.col(f"c.{x}") if x in kids else F.col(f"r.{x}") for x in r.columns if x != "later"])


def bitemporal_ledger(df: DataFrame, keys: list[str], valid: str, recorded: str, values: list[str], unknown: dict[str, list[str]] | None = None, hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The ledger of ``values`` per ``keys``: one row per interval and the span of records in which it was believed.

    Columns: keys, values (as observed; null states nothing), ``valid_from`` and ``valid_to`` (microseconds, null: open),
    ``recorded_from`` and ``recorded_to`` (null: believed now; a null ``recorded`` counts as after all others and shows
    as null), ``superseded``, and ``opens_version``: on the row with which an observation entered the ledger, whether
    after all that is recorded the standing values (last known of each attribute) differ from those before it; null on
    the rows that only shorten an earlier interval.

    Of several rows of one entity and valid time the lowest ``recorded`` holds, of several with that the lowest values
    (nulls first). Rows without a valid time take no part; null keys are keys of their own; ``unknown`` values count as
    null. Extra columns are ignored; an empty table gives no rows.
    """
    unknown = unknown or {}
    us = F.unix_micros(F.col(valid).cast("timestamp"))
    val = {c: F.when(F.col(c).isin(unknown[c]), None).otherwise(F.col(c)) if c in unknown else F.col(c) for c in values}
    e = df.where(F.col(valid).isNotNull()).select(*keys, us.alias("v"), F.coalesce(F.col(recorded).cast("long"), F.lit(LAST_RUN)).alias("run"), *[val[c].alias(c) for c in values])
    # combined before its shuffle, and spread by moment, so that repeated rows cost little
    e = e.groupBy(*keys, "v").agg(F.min(F.struct("run", *values)).alias("r")).select(*keys, "v", F.col("r.run").alias("run"), *[F.col(f"r.{c}").alias(c) for c in values])

    counts = df.where(F.col(valid).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot_keys = cut(counts)
    any_hot = hot_keys.limit(1).count() > 0
    if any_hot:
        points = [i / HOT_CHUNKS for i in range(1, HOT_CHUNKS)]
        h = spread_join(df.where(F.col(valid).isNotNull()).select(*keys, us.alias("v")), hot_keys, keys, "inner")
        bounds = h.groupBy(*keys).agg(F.percentile_approx("v", points, 100_000).alias("q"), F.max("n").alias("n"))
        every = F.greatest(F.lit(1), F.floor(F.lit(HOT_CHUNKS) * chunk_rows / F.col("n"))).cast("int")
        bounds = cut(bounds.select(*keys, F.array_distinct(F.filter("q", lambda x, i: (i + 1) % every == 0)).alias("q")))
        e = spread_join(e, bounds, keys).select(*keys, "v", "run", *values, F.col("q").isNotNull().alias("_hot"), F.coalesce(F.size(F.filter("q", lambda x: x <= F.col("v"))), F.lit(0)).alias("_c"))
        e = e.withColumn("_c", F.when(F.col("_hot"), F.col("_c")).otherwise(F.lit(0)))
    else:
        e = e.withColumns({"_hot": F.lit(False), "_c": F.lit(0)})
    e = e.repartition(*keys, "_c").sortWithinPartitions(*keys, "_c", "v")
    base = e.select(*keys, "_c", "_hot", "v", "run", *values).schema
    kinds = {f.name: f.dataType for f in base.fields}
    fields = list(base.fields)
    for n in ("pred", "succ", "lc", "rc"):
        fields += [T.StructField(f"{n}_{c}", T.LongType()) for c in ("v", "run")]
    for c in values:
        fields += [T.StructField(f"{p}_{c}", kinds[c]) for p in ("pred", "st", "pv")]
    fields.append(T.StructField("_first", T.BooleanType()))
    rows = e.select(*base.fieldNames()).mapInArrow(_sweep(keys, values), T.StructType(fields))
    if any_hot:
        rows = cut(rows)
        rows = rows.where(~F.col("_hot")).unionByName(_across(rows.where("_hot"), keys, values))

    changed = F.col("_first")
    for c in values:
        changed = changed | ~F.col(f"st_{c}").eqNullSafe(F.col(f"pv_{c}"))
    gone_l, gone_r = F.col("lc_v").isNotNull(), F.col("rc_v").isNotNull()
    both = F.array(
        F.struct(F.lit(True).alias("here"), F.col("v").alias("valid_from"), F.col("succ_v").alias("valid_to"), gone_r.alias("superseded"), F.col("rc_run").alias("until")),
        F.struct(F.lit(False).alias("here"), F.col("pred_v").alias("valid_from"), F.col("v").alias("valid_to"), gone_l.alias("superseded"), F.col("lc_run").alias("until")),
    )
    out = rows.withColumn("changed", changed).select("*", F.explode(both).alias("x")).where("x.here or pred_v is not null")
    known = lambda c: F.when(c != LAST_RUN, c)
    return out.select(
        *keys, *[F.when(F.col("x.here"), F.col(c)).otherwise(F.col(f"pred_{c}")).alias(c) for c in values],
        F.col("x.valid_from").alias("valid_from"), F.col("x.valid_to").alias("valid_to"),
        known(F.col("run")).alias("recorded_from"), known(F.col("x.until")).alias("recorded_to"), F.col("x.superseded").alias("superseded"),
        F.when(F.col("x.here"), F.col("changed")).alias("opens_version"),
    )
