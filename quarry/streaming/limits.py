"""Streaming forms: fixed-window request counts and upserts of file tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(requests: DataFrame, limit: int, width: str = "1 minute", late: str = "10 minutes", client: str = "user_id", ts: str = "ts") -> DataFrame:
    """client, start, n, allowed, refused for each fixed window; rows later than the watermark are dropped. Works on batch and streaming frames."""
    by = requests.withWatermark(ts, late).groupBy(client, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select(client, F.col("w.start").alias("start"), "n", F.least("n", F.lit(limit)).alias("allowed"), F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def upsert_into(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str):
    """A foreachBatch function that replaces rows of the same key by those of the batch."""

    def batch(rows: DataFrame, _: int) -> None:
        old = read()
        write(rows if old is None else old.join(rows.select(key), key, "left_anti").unionByName(rows))

    return batch
