import random

from pyspark.sql import functions as F

from parley.operators import numbering
from parley.operators.numbering import with_position
from parley.operators.prep import assign_batches, get_batch, planned_steps


def ids(seed):
    source = random.Random(seed)
    near = [source.randint(0, 5000) for _ in range(300)]
    far = [source.randint(-(2**62), 2**62) for _ in range(200)]
    rows = [(pid << 33) + i for pid in range(5) for i in range(50)]
    return sorted({*near, *far, *rows, -1, 0, 65535, 65536, 2**62 + 5})


def test_positions_are_dense_for_any_key_distribution(spark):
    keys = ids(1)
    shuffled = keys[:]
    random.Random(2).shuffle(shuffled)
    frame = spark.createDataFrame([(key,) for key in shuffled], "row_id bigint").repartition(7)
    got = {row.row_id: row.position for row in with_position(frame).collect()}
    assert got == {key: place for place, key in enumerate(keys)}


def test_slice_is_short_at_the_end(spark):
    frame = spark.createDataFrame([(i * 100003, f"Q{i}") for i in range(10)], "row_id bigint, input string")
    assert [r.input for r in get_batch(frame, 3, 2).orderBy("row_id").collect()] == ["Q2", "Q3", "Q4"]
    assert [r.input for r in get_batch(frame, 5, 8).orderBy("row_id").collect()] == ["Q8", "Q9"]
    assert get_batch(frame, 5, 10).count() == 0


def test_batches_and_steps(spark):
    frame = spark.range(10).withColumnRenamed("id", "row_id")
    batches = [r.batch_no for r in assign_batches(frame, 4).orderBy("row_id").collect()]
    assert batches == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert planned_steps(frame, 4, 3).first().planned_steps == 9
    assert planned_steps(frame, 4, 3, max_steps=100).first().planned_steps == 100


def test_no_unpartitioned_window_over_rows(spark):
    frame = spark.range(10).withColumnRenamed("id", "row_id")
    plan = with_position(frame)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    # The only single-task window is over the top 16 bits.
    assert physical.count("SinglePartition") <= 1


def test_positions_of_wide_and_negative_ids(spark):
    ids = [-(2**62), -1, 0, 1, 2**31 + 5, 2**32 + 1, 2**62]
    rows = [(conv, turn) for conv in ids for turn in (0, 1, 5000, 9000)]
    frame = spark.createDataFrame(rows[::-1], "conv long, turn long").repartition(5)
    placed = numbering.with_position_by(frame, "conv", "turn").collect()
    assert [(r.conv, r.turn) for r in sorted(placed, key=lambda r: r.position)] == sorted(rows)
    assert sorted(r.position for r in placed) == list(range(len(rows)))


def test_rank_by_text_nulls_and_ties(spark):
    source = random.Random(4)
    rows = [(source.choice([None, "", "a", "b", "é", "hot", "hot"]), i) for i in range(900)]
    frame = spark.createDataFrame(rows, "name string, no long").repartition(6)
    ranked = numbering.with_rank(frame, "name", F.desc("no")).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), -r[1]))
    assert [(r.name, r.no) for r in sorted(ranked, key=lambda r: r.position)] == want
    assert sorted(r.position for r in ranked) == list(range(len(rows)))


def test_rank_of_equal_keys_is_dealt_out(spark, tmp_path):
    spark.range(20_000).selectExpr("'same' as name", "id").write.parquet(f"{tmp_path}/t")
    ranked = numbering.with_rank(spark.read.parquet(f"{tmp_path}/t"), "name", name="rank")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(20_000))
    assert numbering.with_rank(spark.range(0), "id").collect() == []


def test_rank_without_window_over_rows(spark):
    plan = numbering.with_rank(spark.range(10), "id")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    # The only single-task window holds one count per partition.
    assert physical.count("SinglePartition") <= 1 and "NestedLoopJoin" not in physical
