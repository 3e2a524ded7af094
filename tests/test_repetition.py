import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import repetition
from parley.session import computed_once


def plain_score(text):
    """The definition in its direct form."""
    tokens = text.lower().split()
    if len(text) < 10 or len(tokens) < 3:
        return 0.0

    def hits(size, start):
        return [
            " ".join(tokens[i : i + size]) in " ".join(tokens[i + size :])
            for i in range(max(len(tokens) - start, 0))
        ]

    pairs, triples = hits(2, 3), hits(3, 5)
    places = len(pairs) + len(triples)
    return min(1.0, (sum(pairs) + 2 * sum(triples)) / places) if places else 0.0


WORDS = st.text(alphabet="abé", min_size=1, max_size=4)


@settings(max_examples=400, deadline=None)
@given(st.lists(WORDS, max_size=40))
def test_both_kernels_equal_the_definition(tokens):
    pairs, triples = max(len(tokens) - 3, 0), max(len(tokens) - 5, 0)
    text = " ".join(tokens)
    assert repetition.repetition_of(text) == plain_score(text)
    if pairs:
        by_search = repetition.hits_by_search(tokens, pairs, triples)
        assert by_search == repetition.hits_by_index(tokens, pairs, triples)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab\u00e9\U0001f642", min_size=1, max_size=5), min_size=4, max_size=60))
def test_no_recurring_pair_is_left_out(tokens):
    """Texts are only searched for few pairs, those that may recur at all."""
    pairs, joined = len(tokens) - 3, " ".join(tokens)
    recur = {i for i in range(pairs) if " ".join(tokens[i : i + 2]) in " ".join(tokens[i + 2 :])}
    assert recur <= set(repetition.met_again(joined, pairs))


def test_few_pairs_of_a_long_text_are_searched_for():
    tokens = [f"{i % 91}word{i % 1009}x" for i in range(3000)] + ["again", "and", "again", "and"]
    assert len(repetition.met_again(" ".join(tokens), len(tokens) - 3)) < 300


def test_long_text_takes_the_index(spark):
    tokens = [f"w{(i * i) % 977}x{i % 13}" for i in range(repetition.LONG_TEXT_WORDS + 300)]
    text = " ".join(tokens)
    assert repetition.repetition_of(text) == plain_score(text)


@pytest.mark.parametrize(
    "text", [None, "", "ab cd", "one two three", "aa bb cc dd", "aa bb cc dd ee", "aa bb cc dd ee ff"]
)
def test_edges(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    got = frame.select(repetition.repetition_score(F.col("t"))).first()[0]
    assert got == (plain_score(text) if text else 0.0)


def test_score_is_computed_once_per_row(spark):
    frame = spark.createDataFrame([("a b a b a b a b",)], "t string")
    scored = computed_once(frame, "s", repetition.repetition_score(F.col("t")))
    plan = scored.where("s > 0.3").withColumn("r", F.col("s") * 2)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("ArrowEvalPython") == 1


def test_nested_words_stay_quick():
    import random
    import time

    rng = random.Random(1)
    tokens = ["a" * rng.randint(1, 200) for _ in range(2500)]
    begin = time.process_time()
    found = repetition.hits_by_index(tokens, 2497, 2495)
    assert time.process_time() - begin < 3
    assert found == repetition.hits_by_search(tokens, 2497, 2495)


def test_plain_filters_reach_the_scan(spark, tables):
    from parley.operators.quality import score_pairs

    documents = spark.read.parquet(f"{tables}/documents.parquet")
    rows = documents.select(F.col("doc_id").alias("row_id"), F.lit("").alias("input"), F.col("text").alias("output"), "lang")
    for wanted in ("lang = 'en'", "lang = 'en' and is_valid", "is_repetitive and lang = 'en'"):
        plan = score_pairs(rows).where(wanted)._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(lang,en)" in plan and plan.count("ArrowEvalPython") == 1, wanted


def test_undecodable_text_scores_zero(spark):
    frame = spark.range(1).select(F.unhex(F.lit("E9")).cast("string").alias("t"))
    assert frame.select(repetition.repetition_score(F.col("t"))).first()[0] == 0
