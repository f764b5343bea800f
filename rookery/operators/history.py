"""Price history of an append-only observation log, latest states, and reconciliation with a set of seen ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ["source", "source_listing_id"]


def direction(delta: Column) -> Column:
    return F.when(delta < 0, "down").when(delta > 0, "up").when(delta == 0, "unchanged").otherwise("first_or_unknown")


def price_history(df: DataFrame, keys: list[str], at: str, price: str, tie: list[Column], span: str = "day", state: DataFrame | None = None) -> DataFrame:
    """Each observation with the last known, first known and least known price up to it, deltas, share and direction.

    The order is ``at``, then ``tie``. Running values are computed inside spans of time and carried from span to span,
    so that one entity with very many observations is spread over its spans. The delta is against the last non-null
    earlier price; the share is null where that is null or 0. Rows without ``at`` take no part. ``state`` (keys, ``last_price``,
    ``first_price``, ``lowest_price``) is what was known before all rows.
    """
    d = df.where(F.col(at).isNotNull()).withColumn("_span", F.date_trunc(span, at))
    w = Window.partitionBy(*keys, "_span").orderBy(F.col(at), *tie)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"_prev": F.last(price, ignorenulls=True).over(before), "_first": F.first(price, ignorenulls=True).over(upto), "_low": F.min(price).over(upto)})
    ends = df.where(F.col(at).isNotNull() & F.col(price).isNotNull()).withColumn("_span", F.date_trunc(span, at))
    order = F.struct(F.col(at), *[t.alias(f"_t{i}") for i, t in enumerate(tie)])
    ends = ends.groupBy(*keys, "_span").agg(F.max_by(price, order).alias("_last"), F.min_by(price, order).alias("_start"), F.min(price).alias("_min"))
    all_spans = d.select(*keys, "_span", F.lit(None).alias("_last"), F.lit(None).alias("_start"), F.lit(None).alias("_min")).unionByName(ends).groupBy(*keys, "_span").agg(*[F.max(c).alias(c) for c in ("_last", "_start", "_min")])
    if state is not None:
        all_spans = all_spans.unionByName(state.select(*keys, F.lit("0001-01-01").cast("timestamp").alias("_span"), F.col("last_price").alias("_last"), F.col("first_price").alias("_start"), F.col("lowest_price").alias("_min")))
    c = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # one row per span
    carry = all_spans.select(*keys, "_span", F.last("_last", ignorenulls=True).over(c).alias("_cl"), F.first("_start", ignorenulls=True).over(c).alias("_cs"), F.min("_min").over(c).alias("_cm"))
    same = F.col("d._span") == F.col("c._span")
    for k in keys:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}"))
    d = d.alias("d").join(carry.alias("c"), same).select("d.*", "c._cl", "c._cs", "c._cm")
    prev, first, low = F.coalesce("_prev", "_cl"), F.coalesce("_cs", "_first"), F.least("_low", "_cm")
    p = F.col(price)
    d = d.withColumns({"previous_price": prev, "first_price": first, "lowest_price": low})
    d = d.withColumns({"delta": p - F.col("previous_price"), "delta_share": F.round(F.try_divide(p - F.col("previous_price"), F.nullif(F.col("previous_price"), F.lit(0))), 4), "delta_from_first": p - F.col("first_price"), "delta_from_lowest": p - F.col("lowest_price")})
    return d.withColumn("direction", direction(F.col("delta"))).drop("_span", "_prev", "_first", "_low", "_cl", "_cs", "_cm")


def price_state(history: DataFrame, keys: list[str], at: str, price: str, tie: list[Column], state: DataFrame | None = None) -> DataFrame:
    """What is known per key after rows of ``price_history`` made with ``state``: ``last_price``, ``first_price``, ``lowest_price``."""
    order = F.struct(F.col(at), *[t.alias(f"_t{i}") for i, t in enumerate(tie)])
    known = F.when(F.col(price).isNotNull(), order)
    new = history.groupBy(*keys).agg(F.max_by(price, known).alias("_l"), F.max_by("previous_price", order).alias("_p"), F.max_by("first_price", order).alias("_f"), F.max_by("lowest_price", order).alias("_m"))
    new = new.select(*keys, F.coalesce("_l", "_p").alias("last_price"), F.col("_f").alias("first_price"), F.col("_m").alias("lowest_price"))
    if state is None:
        return new
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
    kept = state.alias("s").join(new.alias("n"), on, "left_anti")
    return kept.unionByName(new)


def latest(df: DataFrame, keys: list[str], at: str, tie: list[Column], columns: list[str]) -> DataFrame:
    """The latest row's ``columns`` per key; on equal time the least ``tie``. Aggregated before the shuffle."""
    order = F.struct(-F.unix_micros(F.col(at)), *[t.alias(f"_t{i}") for i, t in enumerate(tie)])
    best = F.min_by(F.struct(at, *columns), order).alias("r")
    return df.where(F.col(at).isNotNull()).groupBy(*keys).agg(best).select(*keys, f"r.{at}", *[F.col(f"r.{c}").alias(c) for c in columns])


def latest_change(history: DataFrame, keys: list[str], at: str, tie: list[Column], price: str) -> DataFrame:
    """Per key the most recent non-zero change and the most recent known price."""
    order = F.struct(F.col(at), *[t.alias(f"_t{i}") for i, t in enumerate(tie)])
    moved = F.when(F.col("delta") != 0, F.struct(at, "delta"))
    g = history.groupBy(*keys).agg(F.max_by(moved, F.when(F.col("delta") != 0, order)).alias("m"), F.max_by(price, F.when(F.col(price).isNotNull(), order)).alias("latest_price"))
    return g.select(*keys, F.col(f"m.{at}").alias("changed_at"), F.col("m.delta").alias("latest_delta"), "latest_price")


def delisted(latest_rows: DataFrame, status: str, gone: tuple[str, ...], at: str) -> DataFrame:
    """The latest rows whose status is one of ``gone``, in the order of ``at``."""
    return latest_rows.where(F.col(status).isin(*gone)).orderBy(at, *[k for k in KEYS if k in latest_rows.columns])


def with_marks(observations: DataFrame, marks: DataFrame, at: Column) -> DataFrame:
    """The log with an observation appended for each mark of ``reconcile``: its status at ``at``; fields the mark lacks are null."""
    kinds = dict(observations.dtypes)
    made = {"availability_status": F.col("status"), "observed_at": at}
    new = marks.select(*[(made[c] if c in made else F.col(c) if c in marks.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    return observations.unionByName(new)


def reconcile(scope: DataFrame, seen: DataFrame, state: DataFrame, keys: list[str], seen_total: int | None, full: str = "offline", partial: str = "out_of_window") -> tuple[DataFrame, DataFrame]:
    """(marks, summary) for entities in ``scope`` that aren't in ``seen``.

    The crawl was full if at least ``seen_total`` different keys were seen and the scope is no larger; absent entities are
    then ``full``, else ``partial``. Those whose ``state`` says so already aren't marked again.
    """
    s = scope.select(*keys).distinct()
    counts = s.agg(F.count(F.lit(1)).alias("scope_total")).crossJoin(seen.select(*keys).distinct().agg(F.count(F.lit(1)).alias("seen_unique")))  # one row each
    total = F.lit(seen_total).cast("long")
    counts = counts.withColumn("full", F.coalesce((F.col("seen_unique") >= total) & (F.col("scope_total") <= total), F.lit(False)))
    absent = s.join(seen.select(*keys).distinct(), keys, "left_anti").join(state.select(*keys, F.col("status").alias("previous")), keys, "left")
    absent = absent.crossJoin(F.broadcast(counts.select("full")))  # one row
    absent = absent.withColumn("target", F.when(F.col("full"), full).otherwise(partial)).withColumn("again", F.coalesce(F.col("previous") == F.col("target"), F.lit(False)))
    marks = absent.where(~F.col("again")).select(*keys, "previous", F.col("target").alias("status"))
    n = lambda t, again: F.count_if((F.col("target") == t) & (F.col("again") == F.lit(again)))
    part = absent.agg(F.count(F.lit(1)).alias("_absent"), n(full, False).alias(f"newly_{full}"), n(full, True).alias(f"already_{full}"), n(partial, False).alias(f"newly_{partial}"), n(partial, True).alias(f"already_{partial}"))
    summary = counts.crossJoin(part).withColumn("in_scope_seen", F.col("scope_total") - F.col("_absent")).drop("_absent").withColumnRenamed("full", "is_full")
    return marks, summary
