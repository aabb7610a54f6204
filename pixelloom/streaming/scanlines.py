"""Streaming: scanlines as micro-batches, windows with watermarks, and look-behind as state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def read_events(spark, folder: str, files_per_trigger=1) -> DataFrame:
    """The event table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/events.parquet*")


def windowed(events: DataFrame, size="1 day", late="2 days") -> DataFrame:
    """Tumbling statistics by event type; rows later than the watermark are left out when streaming."""
    w = F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap="6 hours", late="1 day") -> DataFrame:
    """Session windows for each user."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def line_sums(pixels: DataFrame) -> DataFrame:
    """(img, y, total, change): row sums with the change from the line before, lines arriving in any order within a
    batch and in order over batches; the state holds one line."""

    def step(key, frames, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).groupby("y", as_index=False)["v"].sum().sort_values("y")
        out = []
        for y, v in zip(rows["y"], rows["v"]):
            out.append((key[0], int(y), float(v), float(v - last) if last is not None else 0.0))
            last = float(v)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["img", "y", "total", "change"])

    return pixels.groupBy("img").applyInPandasWithState(step, "img string, y int, total double, change double", "last double", "append", GroupStateTimeout.NoTimeout)


def run_to_memory(df: DataFrame, name: str, mode="complete"):
    """Runs a stream over what is there and returns its table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
