"""Records cut by many tasks against whole-file parsers."""

import csv
import io
import json
import random

import pytest

from parley.sources import framing, readers


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def odd_text(rng):
    pieces = ['"', "\\", "{", "}", "}{", ",", "\n", "[", "]", "word", "é🙂", "\r\n", '""', "x" * 90]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))


def records(seed, count=50):
    rng = random.Random(seed)
    return [{"input": odd_text(rng), "output": odd_text(rng), "n": i, "more": {"a": {"b": odd_text(rng)}}} for i in range(count)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_by_many_tasks(small_splits, tmp_path, indent):
    for seed in range(2):
        (tmp_path / f"{seed}.json").write_text(json.dumps(records(seed), indent=indent, ensure_ascii=False))
    cut = framing.json_objects(small_splits, str(tmp_path)).collect()
    for seed in range(2):
        mine = sorted((r for r in cut if r.file.endswith(f"{seed}.json")), key=lambda r: (r.split, r.no))
        assert [json.loads(r.text) for r in mine] == records(seed)
        assert len({r.split for r in mine}) > 5
    rows = readers.read_json(small_splits, str(tmp_path), "n BIGINT").collect()
    assert sorted((r.n, r.input, r.output) for r in rows) == sorted(
        (r["n"], r["input"], r["output"]) for seed in range(2) for r in records(seed)
    )


def test_json_of_one_object_and_of_none(small_splits, tmp_path):
    for name, text in (("one", '{"input": "a", "output": "}"}\n'), ("none", "[]"), ("empty", ""), ("array", ' [ {"input": "b", "output": null} ] \n')):
        (tmp_path / name).write_text(text)
    rows = readers.read_json(small_splits, str(tmp_path), "").collect()
    assert sorted(map(tuple, rows)) == [("a", "}"), ("b", None)]


@pytest.mark.parametrize("text", ['[{"input": "a"}} , {"input": "b"}]', '[{"input": "a"', '[{"input": "a"}, 5, {"input": "b"}]', '[{"input": "a"}] x'])
def test_malformed_json_raises(small_splits, tmp_path, text):
    (tmp_path / "bad").write_text(text)
    with pytest.raises(Exception, match="stray|no end|no array"):
        readers.read_json(small_splits, str(tmp_path), "").collect()


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_csv_by_many_tasks(small_splits, tmp_path, line_end):
    rng = random.Random(4)
    rows = [(str(i), odd_text(rng).replace("\\", ""), odd_text(rng).replace("\\", "")) for i in range(60)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=line_end, quoting=csv.QUOTE_ALL)
    writer.writerow(("id", "question", "answer"))
    writer.writerows(rows)
    (tmp_path / "a.csv").write_bytes((out.getvalue() + line_end).encode())
    frame = readers.read_csv(small_splits, str(tmp_path))
    assert sorted((r.id, r.input or "", r.output or "") for r in frame.collect()) == sorted(rows)
    assert framing.csv_rows(small_splits, str(tmp_path)).select("split").distinct().count() > 5


def test_csv_that_is_wrong_raises(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('question,answer\n"open,x\n' + "y\n" * 200)
    with pytest.raises(Exception, match="no end"):
        readers.read_csv(small_splits, str(tmp_path)).collect()
    (tmp_path / "a.csv").write_text("question,other\n1,2\n")
    with pytest.raises(ValueError, match="must have"):
        readers.read_csv(small_splits, str(tmp_path))


def test_states_joined_beyond_the_broadcast(small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(framing, "BROADCAST_SPLITS", 3)
    (tmp_path / "a.json").write_text(json.dumps(records(5), indent=1))
    cut = framing.json_objects(small_splits, str(tmp_path)).collect()
    assert [json.loads(r.text) for r in sorted(cut, key=lambda r: (r.split, r.no))] == records(5)
