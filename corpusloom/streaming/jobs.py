"""Streams: request rates, deduplicated deliveries, resumable extraction, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.writers import append_cache


def request_rates(events: DataFrame, key: str = "user_id", at: str = "ts", window: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Events per key in sliding windows; state older than the watermark is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, window, slide), key).agg(F.count("*").alias("requests")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "requests")


def over_limit(rates: DataFrame, per_window: int) -> DataFrame:
    return rates.filter(F.col("requests") > per_window)


def first_deliveries(predictions: DataFrame, key: str = "question_id", at: str = "predicted_at", late: str = "1 day") -> DataFrame:
    """The first delivery of each key within the watermark."""
    return predictions.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: events no further apart than ``gap``."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), key)
    return grouped.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), key, "events", "value")


def extract_new(stream: DataFrame, cache_path: str, key: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Starts a stream that extracts the rows the cache lacks; failed rows are tried again when they come again.

    ``extract`` gives ``key``, ``status`` and its result; only successes are cached."""

    def one_batch(batch: DataFrame, _: int) -> None:
        try:
            known = batch.sparkSession.read.parquet(cache_path).select(key)
            batch = batch.join(known, key, "left_anti")
        except Exception as error:  # noqa: BLE001 - the cache does not exist yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        append_cache(extract(batch).filter("status = 'success'"), cache_path, key)

    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
