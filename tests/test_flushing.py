"""Flushes by count, control rows and timer, and feedback by event time."""

import datetime
import json
import time
from collections import Counter

from parley.streaming.flushing import CountedLogStream
from parley.streaming.windows import feedback_windows, late_counts


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    names = ("session", "control", "prompt", "response")
    (folder / name).write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows))


def exchanges(session, start, count):
    return [(session, None, f"{session} {i}", "r") for i in range(start, start + count)]


def flushes(stream):
    return Counter((r.session, r.flush_no, r.cause) for r in stream.log().collect())


def test_flushes_by_count_and_control(spark, tmp_path):
    source = tmp_path / "in"
    stream = CountedLogStream(spark, str(source), str(tmp_path / "out"), flush_rows=3)
    put(source, "1.json", exchanges("a", 0, 7) + exchanges("b", 0, 2) + [(None, None, None, None)])
    stream.start(once=True).awaitTermination()
    assert flushes(stream) == {("a", 0, "count"): 3, ("a", 1, "count"): 3}
    put(source, "2.json", exchanges("b", 2, 2) + [("a", "FLUSH", None, None), (None, "STOP", None, None)])
    stream.start(once=True).awaitTermination()
    more = {("b", 0, "count"): 3, ("a", 2, "FLUSH"): 1, (None, 0, "STOP"): 1}
    assert flushes(stream) == {("a", 0, "count"): 3, ("a", 1, "count"): 3, **more}
    put(source, "3.json", exchanges("a", 7, 1) + [(s, "STOP", None, None) for s in ("a", "b", "empty")])
    stream.start(once=True).awaitTermination()
    assert flushes(stream)["a", 3, "STOP"] == 1 and flushes(stream)["b", 1, "STOP"] == 1
    assert sorted(r.input for r in stream.log().where("session = 'a'").collect()) == [f"a {i}" for i in range(8)]


def test_timer_flushes_what_waits(spark, tmp_path):
    source = tmp_path / "in"
    stream = CountedLogStream(spark, str(source), str(tmp_path / "out"), flush_rows=5, idle_ms=1500)
    put(source, "1.json", exchanges("a", 0, 6))
    stream.start(once=True).awaitTermination()
    time.sleep(2)
    put(source, "2.json", exchanges("b", 0, 1))
    stream.start(once=True).awaitTermination()
    assert flushes(stream) == {("a", 0, "count"): 5, ("a", 1, "timer"): 1}


def test_windows_and_late_rows(spark, tmp_path):
    source, base = str(tmp_path / "in"), datetime.datetime(2024, 1, 1)
    sink = str(tmp_path / "out")

    def add(*rows):
        rows = [(base + datetime.timedelta(minutes=m) if m is not None else None, a) for m, a in rows]
        spark.createDataFrame(rows, "at timestamp, accepted boolean").coalesce(1).write.mode("append").parquet(source)
        windows = feedback_windows(spark.readStream.schema("at timestamp, accepted boolean").parquet(source))
        writer = windows.writeStream.format("parquet").option("path", sink)
        writer = writer.option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()

    add((10, True), (59, False), (60, True), (None, True))
    add((130, False), (5, True))  # arrives late, within the delay
    add((400, None))
    add((20, False), (600, None))  # too late
    closed = spark.read.parquet(sink)
    got = {r.start.hour: (r.accepted, r.corrected) for r in closed.collect()}
    assert got[0] == (2, 1) and got[1] == (1, 0) and got[2] == (0, 1)
    late = late_counts(spark.read.parquet(source), closed).collect()
    assert [(r.start.hour, r.late_accepted, r.late_corrected) for r in late] == [(0, 0, 1)]
