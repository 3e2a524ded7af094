"""Splits of growing files against plain splitting of what is there."""

import random

import pyarrow as pa
import pytest

from parley.sources import growing


def by_hand(data):
    place = 0
    for line in data.split(b"\n")[:-1]:
        yield place, line
        place += len(line) + 1


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_every_finished_line_once(monkeypatch, block):
    monkeypatch.setattr(growing, "READ_BYTES", block)
    rng = random.Random(block)
    for _ in range(200):
        data = bytes(rng.choice(b"ab\n") if rng.random() < 0.4 else 120 for _ in range(rng.randrange(90)))
        sizes = sorted(rng.randrange(len(data) + 1) for _ in range(3)) + [len(data)]
        got, done = [], 0
        for size in sizes:
            for split in growing.splits({"f": done}, {"f": size}, rng.choice([1, 3, 10, 100])):
                got += growing.lines_of(pa.BufferReader(data[:size]), split.start, split.end)
            done = size
        assert got == list(by_hand(data))


def test_hidden_files_are_left_out(tmp_path):
    (tmp_path / "a" / "_temporary").mkdir(parents=True)
    for name in ("one", ".two", "a/three", "a/_temporary/four", "a/_five"):
        (tmp_path / name).write_text("x\n")
    assert sorted(growing.sizes(f"file://{tmp_path}")) == [f"{tmp_path}/a/three", f"{tmp_path}/one"]
    assert growing.sizes(str(tmp_path / "one")) == {f"{tmp_path}/one": 2}


def test_one_file_in_many_tasks(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "feed" / "one").write_text("\n".join(lines) + "\n")
    rows = growing.stream_lines(spark, str(tmp_path / "feed"), split_bytes=20_000)
    query = rows.selectExpr("*", "spark_partition_id() AS part").writeStream.format("memory").queryName("growing_rows")
    query.trigger(availableNow=True).start().awaitTermination()
    got = spark.table("growing_rows").collect()
    assert [r.line for r in sorted(got, key=lambda r: r["at"])] == lines
    assert len({r.part for r in got}) > 5
