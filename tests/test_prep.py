from pyspark.sql import functions as F

from parley.operators import feedback, prep


def test_training_text(spark):
    frame = spark.createDataFrame([("q", "a"), (None, "a")], "i string, o string")
    rows = [r[0] for r in frame.select(prep.training_text(F.col("i"), F.col("o"))).collect()]
    assert rows == ["User: q\nAssistant: a", "User: None\nAssistant: a"]


def test_token_rows(spark):
    frame = spark.createDataFrame([("héy",), ("",), (None,), ("x" * 50,)], "text string")
    rows = prep.token_rows(frame, max_length=8).collect()
    ids = [byte + 3 for byte in "héy".encode()]
    assert rows[0].input_ids == ids + [0] * 4
    assert rows[0].attention_mask == [1] * 4 + [0] * 4
    assert rows[0].labels == ids + [-100] * 4
    assert rows[1].attention_mask == rows[2].attention_mask == [0] * 8
    assert rows[3].input_ids == [ord("x") + 3] * 8 and rows[3].labels == rows[3].input_ids


def test_pad_id_among_tokens_is_ignored_too(spark):
    frame = spark.createDataFrame([("ab",)], "text string")
    row = prep.token_rows(frame, max_length=3, pad_id=ord("a") + 3).first()
    assert row.labels == [-100, ord("b") + 3, -100] and row.attention_mask == [1, 1, 0]


def test_any_tokenizer_function(spark):
    frame = spark.createDataFrame([("hello big world",)], "text string")
    sizes = lambda texts: [[len(word) for word in text.split()] for text in texts]
    row = prep.token_rows(frame, tokenizer=sizes, max_length=4, pad_id=1).first()
    assert row.input_ids == [5, 3, 5, 1]


def test_prompt_limit_is_a_parameter(spark):
    frame = spark.createDataFrame([("p" * 5000,)], "prompt string")
    assert len(frame.select(prep.normal_prompt(F.col("prompt"), None)).first()[0]) == 5000 + 17
    echoed = prep.batch_generate(frame, lambda prompts: [str(len(p)) for p in prompts], max_chars=10)
    assert echoed.first().response == str(10 + 17)


def test_prompt_and_response_frames(spark):
    frame = spark.createDataFrame([("p" * 5000, " x Assistant: y Assistant: \n z ")], "p string, r string")
    row = frame.select(prep.normal_prompt(F.col("p")), prep.clean_response(F.col("r"))).first()
    assert row[0] == "User: " + "p" * 4096 + "\nAssistant:" and row[1] == "z"


def test_batch_generate(spark):
    def echo(prompts):
        return [prompt + " said " + str(len(prompt)) for prompt in prompts]

    frame = spark.createDataFrame([(i, "q" * i) for i in range(20)], "n int, prompt string")
    rows = prep.batch_generate(frame, echo).orderBy("n").collect()
    assert [r.response for r in rows] == [f"said {len('User: ' + 'q' * i + chr(10) + 'Assistant:')}" for i in range(20)]
    built = prep.batch_generate(frame, lambda: echo, factory=True).orderBy("n").collect()
    assert built == rows
    assert prep.batch_generate(frame.limit(0), echo).count() == 0


def test_feedback_labels(spark):
    rows = [("p", "r", None), ("p", "r", " \n"), ("p", "r", " fixed ")]
    frame = spark.createDataFrame(rows, "prompt string, response string, correction string")
    got = feedback.label_feedback(frame).collect()
    assert [(r.output, r.accepted) for r in got] == [("r", True), ("r", True), ("fixed", False)]


def test_quit_ends_a_session(spark):
    rows = [(1, 0, " hi "), (1, 1, ""), (1, 2, " QUIT "), (1, 3, "after"), (2, 0, "quit it"), (2, 1, "q")]
    frame = spark.createDataFrame(rows, "session int, turn int, prompt string")
    kept = feedback.open_prompts(frame, "session").orderBy("session", "turn").collect()
    assert [(r.session, r.turn, r.prompt) for r in kept] == [(1, 0, "hi"), (2, 0, "quit it")]
    assert feedback.open_prompts(frame).count() == 3


def test_feed_counters_may_go_negative(spark):
    frame = spark.createDataFrame([("a",), ("",), ("b",)], "line string")
    row = feedback.feed_counters(frame, 5).first()
    assert (row.total, row.consumed, row.new) == (2, 5, -3)


def test_compact_stamp(spark):
    frame = spark.sql("SELECT timestamp'2024-06-01 12:00:00.123456' AS t")
    assert frame.select(feedback.compact_stamp(F.col("t"))).first()[0] == "20240601T120000123456"
