import pytest
from pyspark.sql import functions as F

from parley import fixed_values as fixed
from parley.operators import quality
from parley.plans import jobs

GOOD = [
    ("What is a lake?", "A lake is a large body of still water, fed by rivers or rain."),
    ("Why is the sky blue?", "Shorter wavelengths scatter more strongly in air molecules."),
]
# (input, output, issues)
CASES = [
    ("hello", "", ["empty"]),
    ("hello", None, ["empty"]),
    ("hello", "  \n ", ["empty", "short", "gibberish"]),
    ("hello", "word word word word word word word", ["repetitive"]),
    ("hello", "yes", ["short"]),
    ("hello", "http://", ["short", "gibberish"]),
    ("hello", " https:// ", ["short", "gibberish"]),
    ("hello", "12 34 5! a", ["gibberish", "incomplete"]),
    ("hello", "1\n2\n3 abc", []),  # line breaks count: 3 letters of 8 visible is enough
    ("hello", "1\n2\n34\n56 abc", ["gibberish"]),  # 3 of 12
    ("hello", "We walked along the river over", ["incomplete"]),
    ("hello", "We walked along the OVER", ["incomplete"]),
    ("hello", "Rust is a systems language", []),
    ("hello", "We walked along th", ["incomplete"]),
    ("hello", "We walked along '.th", ["incomplete"]),
    ("hello", "We walked along th.", []),
    ("hello", "We walked th", []),  # only three words
    ("hello", "We walked along the\nthe", []),  # no plain space before the word
    ("hello", "the", ["short"]),
    ("tell me about old stone bridges", "tell me about old stone bridges today", ["echo"]),
    ("old bridges", "People say old bridges last longer here.", ["echo"]),  # contained
    ("short", "A short answer that contains the word.", []),  # 10 characters or fewer
    ("tell me of stone bridges", "Stone made good bridges once.", []),
    # 3 of 5 distinct words is 0.6 exactly: not above
    ("alpha beta gamma delta epsilon", "Here alpha with beta near gamma now.", []),
    ("alpha beta gamma delta epsilon", "Here alpha with beta near gamma delta ok.", ["echo"]),
    (None, "Nothing was asked here at all.", []),
    ("", "Nothing was asked here at all.", []),
]


def frame(spark, rows):
    numbered = [(i, asked, said) for i, (asked, said, *_) in enumerate(rows)]
    return spark.createDataFrame(numbered, "row_id bigint, input string, output string")


def test_every_case(spark):
    scored = quality.score_pairs(frame(spark, CASES)).orderBy("row_id").collect()
    for row, (asked, said, issues) in zip(scored, CASES):
        assert row.issues == [fixed.ISSUE_TEXT[name] for name in issues], (asked, said)
        assert row.is_valid == (not issues)
        for rule in quality.RULES:
            assert row[f"is_{rule}"] is (rule in issues)


def test_score_of_exactly_the_threshold_is_not_repetitive(spark):
    rows = spark.createDataFrame([("x",)], "t string").select(
        (F.lit(0.3) > fixed.REPETITION_THRESHOLD).alias("at")
    )
    assert rows.first().at is False


def test_toggles_and_thresholds(spark):
    bad = frame(spark, [("hello", "word word word word word word word"), ("hello", "yes")])
    off = quality.QualityConfig(repetitive=False, short=False)
    assert quality.score_pairs(bad, off).where("is_valid").count() == 2
    strict = quality.QualityConfig(min_words=8)
    assert quality.score_pairs(bad, strict).where("is_short").count() == 2
    plan = quality.score_pairs(bad, off)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan


def test_extra_rule(spark):
    config = quality.QualityConfig(extra={"Output shouts": lambda asked, said: said == F.upper(said)})
    rows = quality.score_pairs(frame(spark, [("hi", "THIS IS ALL CAPITALS HERE."), GOOD[0]]), config)
    assert [row.issues for row in rows.orderBy("row_id").collect()] == [["Output shouts"], []]


def test_filter_keeps_rows_and_columns(spark):
    rows = frame(spark, [GOOD[0], ("hi", ""), GOOD[1], ("hi", "no")]).withColumn("extra", F.lit(7))
    kept = quality.filter_valid(rows)
    assert kept.columns == ["row_id", "input", "output", "extra"]
    assert [row.row_id for row in kept.orderBy("row_id").collect()] == [0, 2]


def test_mixed_report(spark, tmp_path):
    rows = frame(spark, [GOOD[0], ("hi", ""), GOOD[1], ("hi", "word word word word word word word")])
    for report in (
        quality.quality_report(quality.score_pairs(rows)).first(),
        jobs.validate(rows, str(tmp_path / "scored")).first(),
    ):
        assert (report.total_conversations, report.valid_conversations, report.invalid_conversations) == (4, 2, 2)
        assert report.quality_score == 0.5 and report.verdict == "ACCEPTABLE" and report.exit_code == 0
        assert report.issue_summary == {
            "empty_outputs": 1, "repetitive_outputs": 1, "short_outputs": 0,
            "gibberish_outputs": 0, "echo_outputs": 0, "incomplete_outputs": 0,
        }
        assert [example["index"] for example in report.problematic_examples] == [1, 3]
        assert report.recommendations == [
            *fixed.ADVICE_WARNING,
            "High repetition detected in 1 conversations",
            "1 conversations have empty outputs",
        ]


def test_examples_are_first_five_and_cut(spark):
    rows = [("q" * 150, "")] + [("q", "no")] * 9
    examples = quality.problematic_examples(quality.score_pairs(frame(spark, rows))).collect()
    assert [row["index"] for row in examples] == [0, 1, 2, 3, 4]
    assert examples[0].input == "q" * 100 and examples[0].output == ""


def test_empty_dataset_has_full_report(spark):
    report = quality.quality_report(quality.score_pairs(frame(spark, []))).first()
    assert report.total_conversations == report.valid_conversations == 0
    assert report.quality_score == 0.0
    assert report.recommendations == [fixed.ADVICE_NO_DATA]
    assert report.problematic_examples == [] and sum(report.issue_summary.values()) == 0


@pytest.mark.parametrize("good,bad,gate", [(9, 1, "go"), (6, 4, "warn"), (4, 6, "blocked")])
def test_gate(spark, good, bad, gate):
    rows = frame(spark, [GOOD[0]] * good + [("hi", "")] * bad)
    totals = quality.quality_totals(quality.score_pairs(rows))
    assert quality.training_gate(totals).first().gate == gate
    assert quality.training_gate(totals, force=True).first().gate != "blocked"


def test_critical_advice(spark):
    rows = frame(spark, [("hi", "")] * 6 + [("hi", "a 1 2 3 4 5")] * 2)
    totals = quality.quality_totals(quality.score_pairs(rows)).first()
    assert totals.recommendations == [
        *fixed.ADVICE_CRITICAL,
        "6 conversations have empty outputs",
        "2 conversations contain gibberish",
    ]
    assert totals.verdict == "CRITICAL" and totals.exit_code == 1


def test_validate_writes_filtered_rows_once(spark, tmp_path):
    rows = frame(spark, [GOOD[0], ("hi", ""), GOOD[1]])
    filtered = str(tmp_path / "filtered")
    report = jobs.validate(rows, str(tmp_path / "scored"), filtered_path=filtered)
    assert jobs.exit_code(report) == 0
    assert sorted(row.row_id for row in spark.read.json(filtered).collect()) == [0, 2]


def test_training_gate_in_job(spark, tmp_path):
    rows = frame(spark, [("hi", "")] * 3)
    with pytest.raises(jobs.QualityTooLow):
        jobs.prepare_training(rows, str(tmp_path / "tokens"))
    forced = jobs.prepare_training(rows, str(tmp_path / "tokens"), force=True, max_length=32)
    assert forced.count() == 3
