"""Keyed storage over Parquet: upsert, insert-or-ignore, append with ids, migration, constraint checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rookery.session import cut


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str, keep_first: str, compat: bool = False) -> DataFrame:
    """Existing rows with incoming ones put over them by key; of several incoming rows the one with the last ``seq`` wins.

    Rows with a null key are dropped. ``keep_first`` keeps the earliest known value; ``compat`` takes the incoming one.
    """
    inc = incoming.dropna(subset=keys)
    rest = [c for c in existing.columns if c not in keys]
    new = inc.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r"), F.min_by(keep_first, seq).alias("_first"))
    old = existing.select(*keys, F.col(keep_first).alias("_old"))
    first = F.col(f"r.{keep_first}") if compat else F.coalesce("_old", "_first")
    new = new.join(old, keys, "left").select(*keys, *[(first if c == keep_first else F.col(f"r.{c}")).alias(c) for c in rest])
    return existing.join(inc.select(*keys).distinct(), keys, "left_anti").select(*keys, *rest).unionByName(new)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The incoming rows that are new by key, of several the one with the least ``seq``: what an insert-or-ignore adds."""
    rest = [c for c in existing.columns if c not in keys]
    first = incoming.dropna(subset=keys).groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return first.join(existing.select(*keys), keys, "left_anti")


def append_with_id(existing: DataFrame, row: DataFrame, id_col: str = "id") -> DataFrame:
    """One more row, numbered after the greatest id (single writer)."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_m"))
    return existing.unionByName(row.crossJoin(top).withColumn(id_col, (F.col("_m") + 1).cast("long")).drop("_m").select(*existing.columns))


def migrate(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns of ``schema`` in its order: shared ones cast, missing ones null or their default, others dropped."""
    defaults = defaults or {}
    return df.select(*[(F.coalesce(F.col(f.name).try_cast(f.dataType), F.lit(defaults.get(f.name)).cast(f.dataType)) if f.name in df.columns else F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in schema.fields])


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null isn't broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())


def split_by_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that don't with ``violations``); a rule that is null isn't broken."""
    d = df.withColumn("violations", violations(rules))
    return d.where(F.size("violations") == 0).drop("violations"), d.where(F.size("violations") > 0)


def first_gap(df: DataFrame, number: str) -> DataFrame:
    """The least positive number missing from ``number``, as one row ``next``."""
    d = df.where(F.col(number) > 0).select(F.col(number).alias("n")).distinct()
    have = d.select((F.col("n") - 1).alias("n"))
    gaps = d.union(d.sparkSession.range(1).select(F.lit(0).cast(dict(d.dtypes)["n"]))).join(have, "n", "left_anti")
    return gaps.agg((F.min("n") + 1).alias("next"))


def longest_prefix(values: DataFrame, value: str, table: DataFrame, prefix: str, name: str) -> DataFrame:
    """Each distinct value with the name of its longest known prefix; equal prefixes go to the least name; null without one.

    Prefixes of the value are exploded and equi-joined, so no nested loop is needed; only those lengths are tried that
    known prefixes have.
    """
    v = values.where(F.col(value).isNotNull()).select(value).distinct()
    t = table.where(F.length(prefix) > 0).groupBy(prefix).agg(F.min(name).alias(name))
    lengths = t.agg(F.collect_set(F.length(prefix)).alias("_ks"))  # one row, of as many numbers as there are lengths
    e = v.crossJoin(F.broadcast(lengths)).select(value, F.explode(F.filter("_ks", lambda k: k <= F.length(value))).alias("_k")).withColumn(prefix, F.expr(f"substring({value}, 1, _k)"))
    best = e.join(t, prefix).groupBy(value).agg(F.max_by(name, "_k").alias(name))
    return v.join(best, value, "left")


def observations_or_listings(observations: DataFrame, listings: DataFrame) -> DataFrame:
    """The observation log; only if it holds nothing at all, one observation per listing at its last sighting.

    ``listings`` has first_seen_at and last_seen_at; the status is then active and the age the days between them.
    """
    days = F.datediff("last_seen_at", "first_seen_at")
    made = {"observed_at": F.col("last_seen_at"), "availability_status": F.lit("active"), "days_on_market": days}
    stand_in = listings.select(*[(made[c] if c in made else F.col(c) if c in listings.columns else F.lit(None)).cast(t).alias(c) for c, t in observations.dtypes])
    empty = observations.agg((F.count(F.lit(1)) == 0).alias("_empty"))  # one row
    return observations.unionByName(stand_in.crossJoin(F.broadcast(empty)).where("_empty").drop("_empty"))


def swap_in(df: DataFrame, folder: str, number: int) -> str:
    """Write a new version of a table beside the old ones and make it the current one; returns its folder.

    The table is written to ``folder``/v``number`` and named current by a marker written after it, so that readers see the old
    version or the new one, never half of it. Writing the same number again replaces it.
    """
    path = f"{folder}/v{number}"
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").json(f"{folder}/done/{number}")
    return path


def current(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, int]:
    """The current version of a table and its number; an empty table and 0 if there is none."""
    try:
        top = spark.read.schema("number long").json(f"{folder}/done/*").agg(F.max("number")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        top = None
    return (spark.read.parquet(f"{folder}/v{top}"), int(top)) if top else (spark.createDataFrame([], schema), 0)


def upsert_store(spark: SparkSession, folder: str, schema: str, incoming: DataFrame, keys: list[str], seq: str, keep_first: str) -> DataFrame:
    """Put rows over the table stored in ``folder`` by key, see ``upsert``, and return the new version."""
    old, number = current(spark, folder, schema)
    return spark.read.parquet(swap_in(upsert(old, incoming, keys, seq, keep_first), folder, number + 1))


def record_observations(spark: SparkSession, folder: str, schema: str, incoming: DataFrame, keys: list[str], seq: str) -> int:
    """Append to the log in ``folder`` the rows that are new by key, of several the first; returns how many were appended."""
    try:
        old = spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], schema)
    new = cut(insert_or_ignore(old, incoming, keys, seq))  # compared with the log before it is written to
    new.write.mode("append").parquet(folder)
    return new.count()
