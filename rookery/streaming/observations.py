"""The observation log as a stream: idempotent delivery, running prices, latest states, event counts, captured pages.

Running prices and latest states are kept as versioned tables: every micro-batch reads the last version, computes its rows
with the batch operators, which spread an entity with very many rows over the cluster, and writes the next version under
its own number. A batch that is delivered again finds its version and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rookery.operators import history as hist, store
from rookery.session import cut


def deliver_once(stream: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Repeated deliveries of a key within the lateness bound are dropped; state is bounded by the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, kind: str, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by window and kind; windows close when the watermark passes them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def captured_pages(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """Captured files as a stream, ``name`` and ``body``, each whole; a query with the same checkpoint goes on where it was."""
    d = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(path)
    return d.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("body"))


def _state_schema(keys: list[str], price: str) -> str:
    return ", ".join([f"{k} string" for k in keys] + [f"{c} {price}" for c in ("last_price", "first_price", "lowest_price")])


def running_prices(folder: str, keys: list[str], at: str, price: str, tie: Callable[[], list[Column]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes rows of ``price_history`` to ``folder``/rows and keeps what is known per key.

    Rows of one entity must arrive in the order of time from batch to batch; within a batch they may come in any order. The
    rows are the same as if all had come at once.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = dict(batch.dtypes)[price]
        state, done = store.current(spark, f"{folder}/state", _state_schema(keys, kind))
        if done > number:
            return
        state = cut(state)
        rows = cut(hist.price_history(batch, keys, at, price, tie(), state=state))
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        store.swap_in(hist.price_state(rows, keys, at, price, tie(), state), f"{folder}/state", number + 1)

    return run


def latest_states(folder: str, keys: list[str], at: str, status: str, tie: Callable[[], list[Column]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest ``status`` per key and writes to ``folder``/changes only those keys whose
    latest status differs from the one known before, so that marking again what is marked changes nothing.

    A row is later than what is known if its time is; of equal times what is known stays.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = ", ".join([f"{k} string" for k in keys] + [f"{at} timestamp", f"{status} string"])
        state, done = store.current(spark, f"{folder}/state", schema)
        if done > number:
            return
        state = cut(state)
        new = hist.latest(batch, keys, at, tie(), [status]).select(*keys, at, status)
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}"))
        j = new.alias("n").join(state.alias("s"), on, "left").where(F.col(f"s.{at}").isNull() | (F.col(f"n.{at}") > F.col(f"s.{at}")))
        j = cut(j.select(*[F.col(f"n.{c}").alias(c) for c in (*keys, at, status)], F.col(f"s.{at}").isNotNull().alias("_known"), F.col(f"s.{status}").alias("previous")))
        j.where(~F.col("_known") | ~F.col(status).eqNullSafe(F.col("previous"))).drop("_known").write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
        kept = state.alias("s").join(j.alias("n"), on, "left_anti")
        store.swap_in(kept.unionByName(j.select(*keys, at, status)), f"{folder}/state", number + 1)

    return run


def slower_profile(current, levels: list[str]):
    """The next slower level of an ordered list; an unknown one gives the second, the last stays."""
    arr = F.array(*[F.lit(x) for x in levels])
    at = F.array_position(arr, current)
    return F.element_at(arr, F.when(at == 0, F.lit(min(2, len(levels)))).otherwise(F.least(at + 1, F.lit(len(levels)))).cast("int"))
