"""Streaming forms of the batch operators: sessions, deduplication, count windows, index upserts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_counts(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions per user by a gap in time; works on a stream (append) and on a table."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.filter("user_id is not null").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per window of event time and type; late rows are taken up to the watermark."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def seen_once(items: DataFrame, late: str = "7 days") -> DataFrame:
    """Each item_id once; on a stream the ids are kept until the watermark passes them."""
    timed = items.withColumn("ts", F.timestamp_seconds("fetched_utc"))
    if items.isStreaming:
        return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["item_id"])
    return timed.dropDuplicates(["item_id"])


def count_windows(items: DataFrame, size: int) -> DataFrame:
    """Windows of ``size`` rows per account, as rows arrive; the state is the open window's sums."""
    schema = "account_hash string, window_no long, n long, n_chars long"

    def step(key: tuple, batches: Iterator, state: GroupState):
        import pandas as pd

        no, n, chars = state.get if state.exists else (0, 0, 0)
        out = []
        for pdf in batches:
            for length in pdf["len"]:
                n, chars = n + 1, chars + int(length)
                if n == size:
                    out.append((key[0], no, n, chars))
                    no, n, chars = no + 1, 0, 0
        state.update((no, n, chars))
        yield pd.DataFrame(out, columns=["account_hash", "window_no", "n", "n_chars"])

    rows = items.filter("account_hash is not null").select("account_hash", F.coalesce(F.length("body"), F.lit(0)).alias("len"))
    return rows.groupBy("account_hash").applyInPandasWithState(step, schema, "no long, n long, chars long", "append", GroupStateTimeout.NoTimeout)


def upsert_index(path: str):
    """A ``foreachBatch`` function that folds a batch of index rows into the table at ``path``.

    Every batch writes a version folder of its own, so a batch that is run again after a fault
    overwrites only itself; readers take the newest row per account over all versions.
    """

    def write(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy("account_hash").orderBy(F.desc("ingested_utc"))
        newest = batch.filter("account_hash is not null").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_index(spark, path: str) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    cols = [c for c in rows.columns if c != "batch"]
    return rows.groupBy("account_hash").agg(F.max_by(F.struct(*[c for c in cols if c != "account_hash"]), F.struct("ingested_utc", "batch")).alias("r")).select("account_hash", "r.*")
