"""Streaming extension: windowed counts of codes, and timelines that are placed as their events arrive. State and progress lie in a checkpoint, so a stream goes on after a restart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, code: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, code, n) of a stream or table of events. In append mode a stream gives a window once the watermark has passed it, and drops later events of it."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), code).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), code, "n")


def kept_up(counted: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregating stream over all that is there now and reads what it has come to. Every batch writes the whole result to a folder of its own, named by its number, so that
    a batch that is repeated after a failure replaces itself; the last one counts."""
    started = counted.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last.append(number)

    stream = started.foreachBatch(write).start()
    stream.awaitTermination()
    spark = counted.sparkSession
    if not last:  # nothing new since the checkpoint: the result of the last batch stands
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        last = [int(s.getPath().getName()) for s in files.listStatus(root)] if files.exists(root) else []
    return spark.read.parquet(f"{path}/{max(last)}") if last else spark.createDataFrame([], counted.schema)


def placed_as_they_arrive(events: DataFrame, case: str, code: str, ts: str, late: str = "1 day", quiet: str = "400 days") -> DataFrame:
    """(case, code, ts, relative_day, occurrence) of a stream of events: what `temporal.timeline_events` tells of a table, for events in the order of their arrival.

    State for a case: its first day and how often each code came. Events behind the watermark (`late`) are dropped; a case without events for `quiet` of event time is
    forgotten, and begins anew with its next one."""
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def place(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        first, codes, counts = state.get if state.exists else (None, [], [])
        seen, newest = dict(zip(codes, counts, strict=True)), None
        for frame in frames:
            out = frame.sort_values([ts, code], kind="stable")
            first = out[ts].iloc[0].date() if first is None else first
            numbers = []
            for c in out[code]:
                seen[c] = seen.get(c, 0) + 1
                numbers.append(seen[c])
            days = (out[ts].dt.normalize() - pd.Timestamp(first)).dt.days + 1
            newest = out[ts].max() if newest is None else max(newest, out[ts].max())
            yield pd.DataFrame({case: key[0], code: out[code], ts: out[ts], "relative_day": days.astype("int32"), "occurrence": pd.Series(numbers, out.index, dtype="int32")})
        state.update((first, list(seen), list(seen.values())))
        if newest is not None:
            state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000) + wait, state.getCurrentWatermarkMs() + 1))

    kinds = dict(events.dtypes)
    schema = f"{case} {kinds[case]}, {code} string, {ts} timestamp, relative_day int, occurrence int"
    return events.withWatermark(ts, late).select(case, code, ts).groupBy(case).applyInPandasWithState(place, schema, "first date, codes array<string>, counts array<int>", "append", GroupStateTimeout.EventTimeTimeout)
