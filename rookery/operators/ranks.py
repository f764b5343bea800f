"""Exact global ranks without a single-partition window: range-partitioned sort plus partition offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rookery.session import cut, parallelism


def global_order(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Rows with ``_pos``, their 0-based position in the order of ``order``.

    The order should end with a unique column; rows that tie in all of it take their places arbitrarily but only once.
    The sorted rows are cut (checkpoint), so positions can't change if a task runs again. The offsets are one row per
    partition.
    """
    n = partitions or parallelism(df.sparkSession)
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    s = cut(s.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    sizes = s.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition of the sort: the number of partitions bounds it
    out = s.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn("_pos", F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid", "_part", "_off")


def cumulative(df: DataFrame, order: list[str], weight: str, partitions: int | None = None) -> DataFrame:
    """Adds ``_upto``: the sum of ``weight`` over all rows up to and with this one, in the order of ``order``.

    Rows must be distinct in ``order``. Range-partitioned sort, running sums inside each partition, and the offsets of the
    partitions, of which there is one row each.
    """
    s = cut(df.repartitionByRange(partitions or parallelism(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = s.groupBy("_part").agg(F.sum(weight).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long").alias("_off"))

    def run(batches):
        total = 0
        for pdf in batches:
            c = pdf[weight].cumsum() + total
            if len(c):
                total = int(c.iloc[-1])
            yield pdf.assign(_upto=c.astype("int64"))

    fields = ", ".join(f"`{n}` {t}" for n, t in s.dtypes)
    out = s.mapInPandas(run, f"{fields}, _upto long")
    return out.join(F.broadcast(offsets), "_part").withColumn("_upto", F.col("_upto") + F.col("_off")).drop("_part", "_off")
