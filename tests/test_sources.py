import json
import threading

import pytest
from pyspark.sql import functions as F

from parley.operators.feedback import open_prompts
from parley.sources import readers, writers
from parley.sources.files import Store


def write(path, lines):
    path.write_text("".join(line + "\n" for line in lines), encoding="utf-8")
    return str(path)


GOOD = [json.dumps({"input": f"Q{i}", "output": f"A{i}"}) for i in range(6)]


def test_json_array_and_single_object(spark, tmp_path):
    array = tmp_path / "array.json"
    array.write_text(json.dumps([{"input": "é", "output": "b", "extra": 1}, {"output": "only"}], indent=2))
    single = tmp_path / "single.json"
    single.write_text(json.dumps({"input": "a", "output": "b"}, indent=2))
    rows = readers.read_json(spark, str(array)).collect()
    assert [(r.input, r.output, r.extra) for r in rows] == [("é", "b", 1), (None, "only", None)]
    assert readers.read_json(spark, str(single), extra="").first()[:] == ("a", "b")
    assert readers.read_json(spark, str(array), extra="extra BIGINT").columns == ["input", "output", "extra"]


def test_broken_json_raises(spark, tmp_path):
    path = write(tmp_path / "bad.json", ["{nope"])
    with pytest.raises(Exception):
        readers.read_json(spark, path, extra="").collect()


def test_size_guard(spark, tmp_path):
    path = write(tmp_path / "big.jsonl", GOOD)
    with pytest.raises(ValueError, match="exceeds maximum"):
        readers.read_jsonl(spark, path, max_bytes=10)
    with pytest.raises(ValueError, match="exceeds maximum"):
        readers.read_json(spark, path, max_bytes=10)
    assert readers.read_jsonl(spark, path, max_bytes=10_000).count() == 6


MIXED = [
    GOOD[0],
    "",
    "NOT JSON",
    '{"only": "metadata"}',
    "   ",
    '{"input": null, "output": null}',
    "{'input': 'q', 'output': 'a'}",
    GOOD[1] + " trailing",
    '["input", "output"]',
    "7",
    '{"input": 5, "output": {"k": [1]}, "accepted": true, "timestamp": "t"}',
    "  " + GOOD[2] + "  ",
    '{"input": "first", "input": "last", "output": "x"}',
]


def test_jsonl_skip_rules(spark, tmp_path):
    rows = readers.read_jsonl(spark, write(tmp_path / "mixed.jsonl", MIXED)).collect()
    assert [(r.input, r.output) for r in rows] == [
        ("Q0", "A0"), (None, None), ("5", '{"k": [1]}'), ("Q2", "A2"), ("last", "x"),
    ]
    assert json.loads(rows[2].extras) == {"accepted": True, "timestamp": "t"} and rows[0].extras is None


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "absent.jsonl")).count()
    total, records = readers.count_and_read_jsonl(spark, str(tmp_path / "absent.jsonl"))
    assert total == 0 and records.count() == 0


def test_offsets_count_differently(spark, tmp_path):
    path = write(tmp_path / "feed.jsonl", MIXED)
    by_line = readers.read_jsonl_from(spark, path, start_line=5).orderBy("line_no").collect()
    assert [r.line_no for r in by_line] == [6, 11, 12, 13]
    total, records = readers.count_and_read_jsonl(spark, path, start_line=5)
    assert total == 11
    assert [r.line_no for r in records.orderBy("line_no").collect()] == [9, 10, 11]
    row = readers.line_totals(spark, path).first()
    assert (row.lines, row.filled_lines) == (13, 11)


def test_line_numbers_over_many_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name in ("a", "b"):
        write(folder / f"{name}.jsonl", [json.dumps({"input": f"{name}{i}", "output": "x" * (i % 50)}) for i in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = readers.read_jsonl_from(spark, str(folder), start_line=1500).collect()
        assert readers.read_lines(spark, str(folder)).select("split_start").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 1000
    assert all(r.input == f"{r.file[-7]}{r.line_no - 1}" for r in rows)


def test_csv_with_renamed_columns(spark, tmp_path):
    path = write(tmp_path / "qa.csv", ["question,answer,tag", "q1,a1,x", "q2,a2,y"])
    rows = readers.read_csv(spark, path)
    assert rows.columns == ["input", "output", "tag"] and rows.count() == 2


def test_rows_in_memory(spark):
    assert readers.add_pairs(spark, [{"input": "a", "output": "b"}]).first()[:] == ("a", "b")
    with pytest.raises(ValueError):
        readers.add_pairs(spark, [{"invalid": "data"}])
    assert readers.sample_pairs(spark).count() == 3
    extra = readers.sample_pairs(spark).withColumn("tag", F.lit("t"))
    assert readers.combine(readers.sample_pairs(spark), extra).where("tag IS NULL").count() == 3


def test_jsonl_append_and_required_columns(spark, tmp_path):
    path = str(tmp_path / "deep" / "pairs")
    rows = readers.add_pairs(spark, [{"input": "ü", "output": None}])
    writers.write_jsonl(rows, path)
    writers.write_jsonl(rows, path)
    back = readers.read_jsonl(spark, path).collect()
    assert [(r.input, r.output) for r in back] == [("ü", None)] * 2
    with pytest.raises(ValueError):
        writers.write_jsonl(rows.drop("output"), path)


def test_csv_with_breaks_quotes_and_commas(spark, tmp_path):
    path = str(tmp_path / "pairs.csv")
    with open(path, "w", encoding="utf-8") as file:
        file.write('question,answer\n"a\nb","he said ""hi"" ok, fine"\nplain,x\n')
    rows = readers.read_csv(spark, path).collect()
    assert [(r.input, r.output) for r in rows] == [("a\nb", 'he said "hi" ok, fine'), ("plain", "x")]
    with pytest.raises(ValueError):
        readers.read_csv(spark, path, input_col="other")


def test_odd_lines_are_skipped_and_counted(spark, tmp_path):
    from parley.operators.feedback import line_kinds

    path = tmp_path / "feed.jsonl"
    half = rb'{"input": "half \ud83d", "output": "x"}'
    whole = rb'{"input": "\ud83d\ude00", "output": "y"}'
    path.write_bytes(b"\n".join([half, whole, b'{"input": "caf\xe9", "output": ""}', b"[1]", b"no", b" "]))
    rows = readers.read_jsonl(spark, str(path)).collect()
    assert sorted(r.input for r in rows) == ["half \ufffd", "\U0001f600"]
    lines = spark.read.text(str(path)).withColumnRenamed("value", "line")
    kinds = {r.kind: r.lines for r in line_kinds(lines).collect()}
    assert kinds == {"usable": 2, "undecodable": 1, "keyless": 1, "malformed": 1}


def test_names_that_spark_does_not_list_are_read(spark, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        for name in ("a.txt", "_b.txt", ".c.txt", "d.md", "_SUCCESS"):
            (tmp_path / folder / name).write_text(f"{folder} {name}\r\n")
    plain = readers.read_text_folder(spark, str(tmp_path / "one")).collect()
    assert {r.name: r.content for r in plain} == {n: f"one {n}\n" for n in ("a.txt", "_b.txt", ".c.txt")}
    both = readers.read_text_folder(spark, f"{tmp_path}/*", ordered=True).collect()
    assert [r.path for r in both] == sorted(r.path for r in both) and len(both) == 6
    assert len(readers.unlisted_files(spark, f"{tmp_path}/*")) == 4


def test_files_of_folders_are_not_listed_on_the_driver(spark, tmp_path):
    names = {f"{k:02d}/{mark}{i}.txt" for k in range(40) for i, mark in enumerate(["", "_", ".", "é %+"])}
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "00" / "deep").mkdir()
    (tmp_path / "00" / "deep" / "no.txt").write_text("no")
    read = readers.read_text_folder(spark, f"{tmp_path}/*")
    assert read.inputFiles() == []  # no file index, which holds every file on the driver
    rows = read.collect()
    assert len(rows) == len(names) and {r.content for r in rows} == names
    assert all(r.path == f"file:{tmp_path}/{r.content}" and r.path.endswith("/" + r.name) for r in rows)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_text_folder(spark, f"{tmp_path}/none").collect()


def test_one_array_file(spark, tmp_path):
    frame = spark.range(900).selectExpr("id", "concat('q ', id, ' é\n') input", "if(id % 7 = 0, NULL, 'a}') output")
    path = f"{tmp_path}/out/pairs.json"
    writers.write_json_array(frame.repartition(5), path, "id")
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    assert [r["id"] for r in stored] == list(range(900)) and stored[7] == {"id": 7, "input": "q 7 é\n", "output": None}
    writers.write_json_array(frame.limit(0), path, "id")
    with open(path, encoding="utf-8") as file:
        assert json.load(file) == []


def test_a_pointer_never_vanishes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("pointers/1", "a")
    seen, done = set(), threading.Event()

    def look():
        while not done.is_set():
            try:
                seen.add((tmp_path / "pointers" / "1").read_text())
            except FileNotFoundError:
                seen.add(None)

    reader = threading.Thread(target=look)
    reader.start()
    for i in range(200):
        store.write("pointers/1", "ab"[i % 2])
    done.set()
    reader.join()
    assert seen <= {"a", "b"}


def test_a_session_with_a_third_of_all_rows(spark):
    rows = [(1, i, " Quit" if i == 9000 else f"p{i}") for i in range(12_000)]
    rows += [(s, i, "quit" if (s, i) == (7, 1) else f"p{i}") for s in range(2, 40) for i in range(3)]
    rows += [(None, 5, "x"), (3, None, "x"), (None, 6, "quit"), (None, 7, "y")]
    frame = spark.createDataFrame(rows, "s long, turn long, prompt string")
    kept = open_prompts(frame, session="s")
    got = sorted((tuple(r) for r in kept.collect()), key=repr)
    want = [(s, i, p) for s, i, p in rows if p.strip().lower() != "quit" and not (s == 1 and i > 9000)]
    want = [r for r in want if not (r[0] == 7 and r[1] > 1) and r != (None, 7, "y")]
    assert got == sorted(want, key=repr)
    plan = kept._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan


def test_log_life_cycle(spark, tmp_path):
    from parley.operators.feedback import conversation_log

    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("p", "r")], "prompt string, response string")
    writers.append_log(conversation_log(rows), path)
    writers.append_log(conversation_log(rows), path)
    log = writers.read_log(spark, path)
    assert log.count() == 2 and log.where("timestamp RLIKE '^[0-9-]{10}T[0-9:.]{15}$'").count() == 2
    writers.save_log(conversation_log(rows), path)
    assert writers.read_log(spark, path).count() == 1
    writers.clear_log(spark, path)
    assert writers.read_log(spark, path).count() == 0
    with pytest.raises(ValueError):
        writers.save_log(conversation_log(rows), None)


def test_feedback_rows_are_feed_lines(spark, tmp_path):
    from parley.operators.feedback import label_feedback

    path = str(tmp_path / "feed")
    rows = spark.createDataFrame([("p", "r", ""), ("p", "r", " better ")], "prompt string, response string, correction string")
    writers.append_feedback(label_feedback(rows), path)
    back = {(r.output, json.loads(r.extras)["accepted"]) for r in readers.read_jsonl(spark, path).collect()}
    assert back == {("r", True), ("better", False)}


def test_exchanges_are_stamped(spark, tmp_path):
    path = str(tmp_path / "exchanges")
    rows = spark.createDataFrame([("{}", "text")], "request_json string, response string")
    writers.append_exchanges(rows, path)
    assert spark.read.json(path).where("stamp RLIKE '^[0-9]{8}T[0-9]{12}$'").count() == 1


@pytest.mark.parametrize("fmt", ["json", "csv", "table"])
def test_prediction_files(spark, tmp_path, fmt):
    rows = spark.createDataFrame([("2024-01-01T10:00:00", 20.5)], "datetime string, temp double")
    path = str(tmp_path / fmt)
    writers.write_predictions(rows, path, fmt, ["temp"])
    lines = [r.value for r in spark.read.text(path).collect()]
    assert "20.5" in lines[-1] and len(lines) == {"json": 1, "csv": 2, "table": 3}[fmt]


@pytest.mark.parametrize(
    "path,filtered",
    [("/d/pairs.json", "/d/pairs_filtered.json"), ("pairs", "pairs_filtered"), ("/d.x/.hidden", "/d.x/.hidden_filtered")],
)
def test_filtered_name(path, filtered):
    assert writers.filtered_path(path) == filtered


def test_snapshots_keep_current_and_previous(spark, tmp_path):
    snapshots = writers.Snapshots(spark, str(tmp_path / "snap"), keep=2)
    assert snapshots.current() is None
    with pytest.raises(ValueError):
        snapshots.read()
    for version in (3, 5, 9):
        snapshots.publish(spark.range(version), version)
    assert snapshots.versions() == [5, 9] and snapshots.read().count() == 9
    assert snapshots.read(5).count() == 5 and not (tmp_path / "snap/data/version=3").exists()
    snapshots.publish(spark.range(2), 9)
    assert snapshots.read().count() == 2 and snapshots.versions() == [5, 9]
