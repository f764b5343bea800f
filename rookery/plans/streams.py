"""Queries that run as streams over the test tables until all is read, with the SQL of the batch that they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rookery.operators import history as hist, store
from rookery.plans.listings import HIST, R, _dated, _listings, _snaps, _state, _tie
from rookery.plans.records_sql import STREAMS_SQL as ORACLE
from rookery.session import work_folder
from rookery.sources import pages, table
from rookery.streaming import observations as obs

COLUMNS = (*hist.KEYS, "observed_at", "crawl_run_id", "rent_price", "availability_status", "days_on_market")


def _stream(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    known = spark.read.parquet(path)
    reader = spark.readStream.schema(known.schema)
    if known.inputFiles()[0].endswith(f"/{name}.parquet"):  # one file: a stream reads its folder
        reader, path = reader.option("pathGlobFilter", f"{name}.parquet"), d
    return reader.parquet(path).select(*columns)


def _drain(stream: DataFrame, run, folder: str) -> None:
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def _price_tie():
    return [*_tie(), F.coalesce("days_on_market", F.lit(-1))]


def stream_price_history(spark, d):
    """The price history kept by micro-batches."""
    folder = work_folder(spark, "prices")
    run = obs.running_prices(folder, hist.KEYS, "observed_at", "rent_price", _price_tie)
    _drain(_stream(spark, d, "listing_observations", *COLUMNS), lambda b, n: run(b.distinct(), n), folder)
    return spark.read.parquet(f"{folder}/rows").select(*hist.KEYS, F.unix_micros("observed_at").alias("observed_us"), "rent_price", *HIST)


def stream_latest_status(spark, d):
    """The latest status of each listing kept by micro-batches."""
    folder = work_folder(spark, "states")
    _drain(_stream(spark, d, "listing_observations", *COLUMNS), obs.latest_states(folder, hist.KEYS, "observed_at", "availability_status", _tie), folder)
    x, _ = store.current(spark, f"{folder}/state", "")
    return x.select(*hist.KEYS, F.unix_micros("observed_at").alias("observed_us"), "availability_status")


def stream_delivery(spark, d):
    """Observations delivered once: of rows with the same listing, time and run within ten days one stays."""
    folder = work_folder(spark, "once")
    s = obs.deliver_once(_stream(spark, d, "listing_observations", *hist.KEYS, "observed_at", "crawl_run_id"), [*hist.KEYS, "observed_at", "crawl_run_id"], "observed_at", "3650 days")
    q = s.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select(*hist.KEYS, F.unix_micros("observed_at").alias("observed_us"), "crawl_run_id")


def stored_snapshots(spark, d):
    """Snapshots put into a stored table one after the other, by date; every version replaces the one before."""
    folder = work_folder(spark, "snapshots")
    s = _snaps(spark, d)
    schema = "source string, source_listing_id string, title string, rent_price int, first_us long"
    for day in [r[0] for r in s.select("snapshot_date").distinct().orderBy("snapshot_date").collect()]:  # a calendar
        out = store.upsert_store(spark, folder, schema, s.where(F.col("snapshot_date") == F.lit(day)), hist.KEYS, "seq", "first_us")
    return out


def stored_observations(spark, d):
    """Observations appended to a stored log in two deliveries, the second of which brings everything again."""
    folder = work_folder(spark, "log")
    o = table(spark, d, "listing_observations", *COLUMNS).where("observed_at is not null").withColumn("seq", F.struct(F.coalesce("crawl_run_id", F.lit(1 << 30)), F.coalesce("rent_price", F.lit(-1)), F.coalesce("availability_status", F.lit("")), F.coalesce("days_on_market", F.lit(-1))))
    schema = "source string, source_listing_id string, observed_at timestamp, rent_price int, availability_status string"
    keys = [*hist.KEYS, "observed_at"]
    store.record_observations(spark, folder, schema, o.where("month(observed_at) % 2 = 0"), keys, "seq")
    store.record_observations(spark, folder, schema, o, keys, "seq")
    return spark.read.parquet(folder).select(*hist.KEYS, F.unix_micros("observed_at").alias("observed_us"), "rent_price", "availability_status")


def stored_pages(spark, d):
    """Pages saved under names of their content, those saved before not again: how many each delivery brought."""
    folder = work_folder(spark, "pages")
    r = table(spark, d, "rental_listings", "listing_id", "title", "last_seen_at").where("title is not null and last_seen_at is not null")
    first = pages.save_captured(r.where("listing_id % 2 = 0"), "title", "last_seen_at", folder)
    second = pages.save_captured(r, "title", "last_seen_at", folder)
    n = lambda x, name: x.agg(F.lit(name).alias("delivery"), F.count(F.lit(1)).alias("pages"))
    return n(first, "first").unionByName(n(second, "second")).unionByName(n(spark.read.parquet(folder), "stored"))


def reconcile_marks(spark, d):
    """The marks of a partial reconciliation appended to the log, and reconciled again: nothing is marked twice."""
    scope = _listings(spark, d).where(F.col("rent_price").between(R.min_rent, R.max_rent) & F.col("district").isNotNull()).select(*hist.KEYS)
    seen = _dated(table(spark, d, "listing_snapshots", "snapshot_date", *hist.KEYS), F.max).where("snapshot_date = _date").select(*hist.KEYS)
    log = table(spark, d, "listing_observations", *COLUMNS).distinct()
    marks, _ = hist.reconcile(scope, seen, _state(spark, d), hist.KEYS, None)
    after = hist.with_marks(log, marks, F.lit("2027-01-01").cast("timestamp"))
    state = hist.latest(after, hist.KEYS, "observed_at", _tie(), ["availability_status"]).withColumnRenamed("availability_status", "status")
    again = hist.reconcile(scope, seen, state, hist.KEYS, None)[1].select("newly_out_of_window", "already_out_of_window")
    return after.agg(F.count(F.lit(1)).alias("observations")).crossJoin(again)  # one row each


QUERIES = {f.__name__: f for f in (stream_price_history, stream_latest_status, stream_delivery, stored_snapshots, stored_observations, stored_pages, reconcile_marks)}

__all__ = ["ORACLE", "QUERIES"]
