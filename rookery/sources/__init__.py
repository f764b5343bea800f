"""Scans. Every reader names its columns, so that pruning and pushdown reach the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``; only ``columns`` if any are named."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def typed_rows(raw: DataFrame, schema: str, flags: tuple[str, ...] = (), key: str | None = None) -> DataFrame:
    """Rows of texts as ``schema``: whole numbers may be written as decimals, flags are true for the word true of any case and
    false otherwise, rows with a blank ``key`` are dropped, texts that don't fit are null.
    """
    out = []
    for n, t in (f.strip().split(" ", 1) for f in schema.split(",")):
        c = F.col(n)
        if n in flags:
            c = F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))
        elif t in ("int", "bigint", "long"):
            c = c.try_cast("double").try_cast(t)
        elif t != "string":
            c = c.try_cast(t)
        out.append(c.alias(n))
    d = raw.select(*out)
    return d.where(F.coalesce(F.trim(key), F.lit("")) != "") if key else d


def typed_csv(spark: SparkSession, path: str, schema: str, flags: tuple[str, ...] = (), key: str | None = None) -> DataFrame:
    """A CSV with a header as ``schema``, see ``typed_rows``."""
    names = [f.strip().split(" ", 1)[0] for f in schema.split(",")]
    raw = spark.read.option("header", True).schema(", ".join(f"{n} string" for n in names)).csv(path)
    return typed_rows(raw, schema, flags, key)


def last_by_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each ``key`` that isn't blank: the last one in the order of ``order``."""
    d = df.where(F.coalesce(F.trim(key), F.lit("")) != "")
    rest = [c for c in df.columns if c != key]
    best = d.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An event log of JSON lines; broken lines are dropped."""
    raw = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")
    return raw.dropna(how="all")


def missing_layers(layers: dict[str, DataFrame]) -> list[str]:
    """Names of the layers without rows, one look at each."""
    return [n for n, df in layers.items() if df.isEmpty()]
