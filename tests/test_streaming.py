"""Streams with late events, state and a restart."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cohortloom.operators import temporal
from cohortloom.streaming import timelines

START = datetime(2024, 3, 1, 12)
SCHEMA = "case_id long, code string, ts timestamp"


def _put(spark, path, rows):
    data = [(c, k, START + timedelta(hours=h)) for c, k, h in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream, path, checkpoint):
    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def test_whole_results_go_on_after_a_restart(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    counted = lambda: timelines.windowed_counts(_stream(spark, source), "ts", "code")
    for rows in ([(1, "a", 0), (1, "b", 1), (2, "a", 30)], [(1, "a", 2), (3, "a", 200)]):
        _put(spark, source, rows)
        got = timelines.kept_up(counted(), out, state)
        want = timelines.windowed_counts(spark.read.parquet(source), "ts", "code")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = timelines.kept_up(counted(), out, state)  # nothing new
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))


def test_late_events_are_dropped(spark, tmp_path):
    """The watermark is a day behind the newest event; it lies in the checkpoint, so the event that comes late after the restart is dropped."""
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    counted = lambda: timelines.windowed_counts(_stream(spark, source), "ts", "code")
    _put(spark, source, [(1, "a", 0), (1, "a", 1)])
    _put(spark, source, [(2, "a", 100)])
    _run(counted(), out, state)
    _put(spark, source, [(3, "a", 2), (3, "a", 99), (3, "b", 400)])
    _run(counted(), out, state)
    got = {(r["start"].strftime("%d"), r["code"]): r["n"] for r in spark.read.parquet(out).collect()}
    assert got == {("01", "a"): 2, ("05", "a"): 2}  # the day of hour 99 and 100; the last window is still open


def test_timelines_as_events_arrive(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    batches = [[(1, "a", 0), (1, "b", 1), (2, "a", 5)], [(1, "a", 26), (2, "b", 30)], [(1, "a", 27), (2, "a", 50), (3, "c", 51)]]
    for rows in batches:  # a restart before each batch
        _put(spark, source, rows)
        _run(timelines.placed_as_they_arrive(_stream(spark, source), "case_id", "code", "ts"), out, state)
    table = spark.read.parquet(source).select("case_id", "code", "ts", F.to_date("ts").alias("day"))
    want = temporal.timeline_events(table, "case_id", "code", "day", "ts").select("case_id", "code", "ts", "relative_day", "occurrence")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_quiet_cases_are_forgotten(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for rows in ([(1, "a", 0)], [(2, "a", 24 * 20)], [(2, "b", 24 * 40)], [(1, "a", 24 * 41)]):
        _put(spark, source, rows)
        _run(timelines.placed_as_they_arrive(_stream(spark, source), "case_id", "code", "ts", quiet="5 days"), out, state)
    got = [(r["relative_day"], r["occurrence"]) for r in spark.read.parquet(out).where("case_id = 1").orderBy("ts").collect()]
    assert got == [(1, 1), (1, 1)]
