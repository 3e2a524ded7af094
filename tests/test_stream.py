import json

import pytest

from parley.sources.files import Store
from parley.streaming.feedback_stream import FailsOnce, FeedbackStream, FeedState, LogStream, run_with_budget


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))


def good(start, count):
    return [json.dumps({"input": f"Q{i}", "output": f"A{i}"}) for i in range(start, start + count)]


def texts(stream, version=None):
    return sorted(r.text for r in stream.snapshots.read(version).collect())


def expected(start, count):
    return sorted(f"User: Q{i}\nAssistant: A{i}" for i in range(start, start + count))


def drain(stream, **options):
    stream.start(once=True, **options).awaitTermination()


def test_cycles_over_a_growing_folder(spark, tmp_path):
    feed = tmp_path / "feed"
    stream = FeedbackStream(spark, str(feed), str(tmp_path / "root"), threshold=10)
    put(feed, "1.jsonl", good(0, 6) + ["", "NOT JSON"])
    drain(stream)
    # Seven lines are pending: below the threshold nothing is consumed.
    assert stream.state() == FeedState(7, 0, -1, 0) and stream.snapshots.current() is None

    put(feed, "2.jsonl", good(6, 3))
    drain(stream)
    # The malformed line counts towards the threshold but yields no text.
    assert stream.state() == FeedState(10, 10, 1, 1) and texts(stream) == expected(0, 9)

    put(feed, "3.jsonl", good(9, 4))
    drain(stream)
    assert stream.state().pending == 4 and texts(stream) == expected(0, 9)

    put(feed, "4.jsonl", good(13, 8))
    drain(stream)
    assert stream.state() == FeedState(22, 22, 3, 2) and texts(stream) == expected(9, 12)
    assert texts(stream, stream.snapshots.versions()[0]) == expected(0, 9)


def test_one_file_per_batch_loses_nothing(spark, tmp_path):
    feed = tmp_path / "feed"
    for number in range(6):
        put(feed, f"{number}.jsonl", good(number * 5, 5))
    stream = FeedbackStream(spark, str(feed), str(tmp_path / "root"), threshold=15)
    drain(stream, files_per_batch=1)
    assert stream.state().lines_total == 30 and stream.state().cycles == 2
    first, second = stream.snapshots.versions()
    assert sorted(texts(stream, first) + texts(stream, second)) == expected(0, 30)


def test_repeated_batch_changes_nothing(spark, tmp_path):
    stream = FeedbackStream(spark, str(tmp_path / "feed"), str(tmp_path / "root"), threshold=5)
    for batch, start in enumerate((0, 3)):
        lines = spark.createDataFrame([(line,) for line in good(start, 3)], "line string")
        stream.take(lines, batch)
        before = stream.state()
        stream.take(lines, batch)
        assert stream.state() == before
    assert stream.state() == FeedState(6, 6, 1, 1) and texts(stream) == expected(0, 6)


def test_no_usable_record_still_advances(spark, tmp_path):
    stream = FeedbackStream(spark, str(tmp_path / "feed"), str(tmp_path / "root"), threshold=2)
    stream.take(spark.createDataFrame([("bad",), ("worse",)], "line string"), 0)
    assert stream.state() == FeedState(2, 2, 0, 1) and stream.snapshots.current() is None


def test_staging_of_old_cycles_is_dropped(spark, tmp_path):
    stream = FeedbackStream(spark, str(tmp_path / "feed"), str(tmp_path / "root"), threshold=1)
    for batch in range(4):
        stream.take(spark.createDataFrame([(good(batch, 1)[0],)], "line string"), batch)
    assert Store(spark, str(tmp_path / "root")).names("staging") == ["batch=3"]
    assert stream.snapshots.versions() == [0, 1, 2, 3] and texts(stream) == expected(3, 1)
    assert stream.snapshots.read_all().count() == 4


def test_a_grown_feed_file_raises(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "one.jsonl").write_text(good(0, 1)[0] + "\n")
    stream = FeedbackStream(spark, str(feed), str(tmp_path / "root"), threshold=1)
    stream.start(once=True).awaitTermination()
    with open(feed / "one.jsonl", "a") as file:
        file.write(good(1, 1)[0] + "\n")
    (feed / "two.jsonl").write_text(good(2, 1)[0] + "\n")
    with pytest.raises(Exception, match="has grown"):
        stream.start(once=True).awaitTermination()


class Failing:
    def __init__(self, outcomes):
        self.outcomes, self.runs = outcomes, 0

    def start(self):
        self.runs += 1
        return self

    def awaitTermination(self):
        if self.outcomes[self.runs - 1]:
            raise OSError("lost")


def test_failure_budget():
    query = Failing([True] * 9)
    with pytest.raises(OSError):
        run_with_budget(query.start, lambda: 0, failures=5)
    assert query.runs == 5
    recovering = Failing([True] * 4 + [True] * 4 + [False])
    run_with_budget(recovering.start, lambda: recovering.runs // 5, failures=5)
    assert recovering.runs == 9


def test_log_stream(spark, tmp_path):
    source = tmp_path / "exchanges"
    put(source, "1.json", [json.dumps({"prompt": f"p{i}", "response": "r"}) for i in range(4)])
    stream = LogStream(spark, str(source), str(tmp_path / "root"))
    drain(stream)
    put(source, "2.json", [json.dumps({"prompt": "p4", "response": "r"})])
    drain(stream)
    log = spark.read.json(str(tmp_path / "root" / "log"))
    assert sorted(r.input for r in log.collect()) == [f"p{i}" for i in range(5)]
    assert set(log.columns) == {"input", "output", "timestamp"}


def test_lines_added_to_a_file(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    stream = FeedbackStream(spark, str(feed), str(tmp_path / "root"), threshold=4, growing=True)
    lines = good(0, 9)
    with open(feed / "one.jsonl", "a") as file:
        # The last line has no end yet: it waits.
        file.write("\n".join(lines[:4]))
        file.flush()
        drain(stream)
        assert stream.state() == FeedState(3, 0, -1, 0)
        file.write("\n" + lines[4][:9])
        put(feed, "two.jsonl", ["", "NOT JSON", lines[8]])
        put(feed, "_writing.jsonl", lines)
        file.flush()
        drain(stream)
        assert stream.state() == FeedState(6, 6, 1, 1)
        file.write(lines[4][9:] + "\r\n" + "\r\n".join(lines[5:8]) + "\n")
    drain(stream)
    first, second = stream.snapshots.versions()
    assert texts(stream, first) == sorted(expected(0, 4) + expected(8, 1))
    assert texts(stream, second) == expected(4, 4)


def test_a_file_that_shrank_raises(spark, tmp_path):
    feed = tmp_path / "feed"
    put(feed, "one.jsonl", good(0, 3))
    stream = FeedbackStream(spark, str(feed), str(tmp_path / "root"), threshold=1, growing=True)
    drain(stream)
    put(feed, "one.jsonl", good(0, 1))
    with pytest.raises(Exception, match="shrank"):
        drain(stream)


def test_a_batch_fails_after_publishing(spark, tmp_path):
    feed = tmp_path / "feed"
    put(feed, "one.jsonl", good(0, 5))
    stream = FailsOnce(spark, str(feed), str(tmp_path / "root"), threshold=3)
    with pytest.raises(Exception, match="lost"):
        drain(stream)
    assert stream.state() == FeedState() and stream.snapshots.versions() == [0]
    drain(stream)
    assert stream.state() == FeedState(5, 5, 0, 1) and texts(stream) == expected(0, 5)
    assert stream.snapshots.read_all().count() == 5
