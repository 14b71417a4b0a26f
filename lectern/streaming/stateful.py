"""Stateful operators: fixed-window rate limiter, latest-wins merge, and event-time windows.

The limiter's window begins with a key's first event after the last window
ended; it is neither an epoch-aligned window nor a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.folds import numbered_in_order


def rate_limit(events: DataFrame, key: str, ts: str, tie: str, window_us: int, most: int) -> DataFrame:
    """(key, tie, ts, window_start, position, remaining, allowed) of a batch of events.

    A key's events are scanned in order; a new window opens at the first event at
    or after the last one's end.  max <= 0 turns the limit off.
    """
    rows = events.select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(ts).alias("ts"))
    none = F.lit(None).cast("long")
    if most <= 0:
        return rows.select("key", "tie", "ts", none.alias("window_start"), none.alias("position"), none.alias("remaining"), F.lit(True).alias("allowed"))

    def step(state: tuple | None, z: tuple) -> tuple[tuple, tuple]:
        start, n = (z[0], 1) if state is None or z[0] >= state[0] + window_us else (state[0], state[1] + 1)
        return (start, n), (start, n)

    out = numbered_in_order(rows, ["key"], ["us", "tie"], ["us"], None, step, ["window_start", "position"])
    n = F.col("position")
    return out.select("key", "tie", "ts", "window_start", n, F.greatest(F.lit(0).cast("long"), most - n).alias("remaining"), (n <= most).alias("allowed"))


def rate_limit_stream(events: DataFrame, key: str, ts: str, tie: str, window_us: int, most: int) -> DataFrame:
    """The limiter over a stream: per-key state (window start, count), dropped when its window has passed.

    events need a watermark on ts; state times out by event time, so it does not
    grow with the number of keys ever seen.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        # events of one trigger come in any order
        rows = pd.concat(list(batches)).sort_values(["us", "tie"])
        out = []
        for us, t in zip(rows["us"].tolist(), rows["tie"].tolist(), strict=True):
            if start is None or us >= start + window_us:
                start, n = us, 0
            n += 1
            out.append((k[0], t, us, start, n, max(0, most - n), n <= most))
        state.update((int(start), int(n)))
        state.setTimeoutTimestamp(max((start + window_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "tie", "us", "window_start", "position", "remaining", "allowed"])

    rows = events.withColumn("us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("key", F.col(key)).withColumn("tie", F.col(tie))
    schema = f"key {dict(rows.dtypes)['key']}, tie {dict(rows.dtypes)['tie']}, us long, window_start long, position long, remaining long, allowed boolean"
    return rows.groupBy("key").applyInPandasWithState(run, schema, "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last upload per key."""
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def merge_latest(path: str, keys: list[str], *order: str):
    """A foreachBatch function that appends a micro-batch's latest row per key under path.

    A batch writes its own rows alone, in a folder of its epoch, so work follows
    the batch and a batch that is run again replaces what it wrote.  Rows are
    merged when they are read: read_latest; compacted() folds old epochs.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        latest_wins(batch, keys, *order).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return run


def read_latest(spark: SparkSession, path: str, schema: str, keys: list[str], *order: str) -> DataFrame:
    """The latest row per key of all that merge_latest wrote."""
    return latest_wins(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path), keys, *order)


def compacted(spark: SparkSession, path: str, target: str, schema: str, keys: list[str], *order: str) -> DataFrame:
    """Writes the merged rows to another path, from which appending may go on, and reads them."""
    read_latest(spark, path, schema, keys, *order).write.parquet(f"{target}/epoch=-1")
    return read_latest(spark, target, schema, keys, *order)


def windowed_counts(events: DataFrame, ts: str, keys: list[str], length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts per event-time window (tumbling, or sliding with slide); late sets a watermark for streams."""
    rows = events.withWatermark(ts, late) if late else events
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """Sessions per key that end after a gap: (key, start, end, n)."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")
