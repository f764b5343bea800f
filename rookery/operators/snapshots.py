"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def strip_spaces(c):
    """Outer white space of any kind (ideographic and zero-width ones too) taken off."""
    return F.regexp_replace(c, r"(?U)^[\s​﻿]+|[\s​﻿]+$", "")


def snapshot_changes(df: DataFrame, snapshot: str, keys: list[str], values: list[str], latest: str, stripped: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """Added, removed and changed keys between each two consecutive values of ``snapshot``.

    Of several rows of a key in a snapshot the one with the latest ``latest`` holds (null is earliest; then ``ties``,
    then the values decide, so the result doesn't depend on row order). Null is a value of its own, in keys as in
    values. ``stripped`` columns are compared without outer white space. Rows whose snapshot is null belong to none.
    Identical rows are removed by EXCEPT ALL both ways; what is left is full-joined by key, so that the join sees
    changes only. Returns ``snapshot``, the keys and ``change``.
    """
    d = df.where(F.col(snapshot).isNotNull()).select(snapshot, *keys, latest, *[c for c in ties if c != latest], *[strip_spaces(F.col(c)).alias(c) if c in stripped else c for c in values])
    order = F.struct(latest, *[c for c in ties if c != latest], *values)
    rows = d.groupBy(snapshot, *keys).agg(F.max(order).alias("_r")).select(snapshot, *keys, *[F.col(f"_r.{v}").alias(v) for v in values])
    # one row per snapshot: a calendar
    w = Window.orderBy(snapshot)
    days = df.where(F.col(snapshot).isNotNull()).select(snapshot).distinct().select(snapshot, F.lead(snapshot).over(w).alias("_next"), F.lag(snapshot).over(w).alias("_prev"))
    old = rows.join(days.where("_next is not null").select(snapshot, "_next"), snapshot).select(F.col("_next").alias(snapshot), *keys, *values)
    new = rows.join(days.where("_prev is not null").select(snapshot), snapshot).select(snapshot, *keys, *values)
    gone = old.exceptAll(new).select(snapshot, *keys, F.lit(True).alias("_old"))
    come = new.exceptAll(old).select(snapshot, *keys, F.lit(True).alias("_new"))
    g = gone.select(F.col(snapshot).alias("_g0"), *[F.col(k).alias(f"_g{i + 1}") for i, k in enumerate(keys)], "_old")
    on = [F.col(snapshot).eqNullSafe(F.col("_g0")), *[F.col(k).eqNullSafe(F.col(f"_g{i + 1}")) for i, k in enumerate(keys)]]
    j = come.join(g, on, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    pick = lambda c, i: F.when(F.col("_new").isNull(), F.col(f"_g{i}")).otherwise(F.col(c)).alias(c)
    return j.select(pick(snapshot, 0), *[pick(k, i + 1) for i, k in enumerate(keys)], change.alias("change"))
