"""Quality rules whose thresholds adapt to language and source.

Each document is measured once.  Per language, source and rule the measures are
counted in buckets of at most 1/32 relative width.  Such a histogram is a quantile
sketch of bounded size that merges by adding counts: tasks pre-aggregate their own,
sources are merged into languages and languages into the corpus, and groups of fewer
than ``least`` documents use the sketch one level up.  The fences are the quartiles plus
or minus ``reach`` times the quartile distance, which is at least the rule's ``least``
spread; they replace fixed cut-offs.  Documents are then filtered by joining the fences.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from parley.llm.common import look_up, stored
from parley.session import spread

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class Rule:
    """Measure ``scale * top // bottom``; ``spread`` is the least quartile distance."""

    name: str
    top: str
    bottom: str
    scale: int
    spread: int
    both: bool = False


RULES = (
    Rule("symbols", "n_symbols", "n_words", 1000, 30),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1000, 60),
    Rule("repeats", "n_repeat_words", "n_words", 1000, 80),
    Rule("word_length", "word_chars", "n_words", 100, 40, both=True),
)
#: Quartile distances from the quartiles to the fences.
REACH = 6
#: Documents that a group needs for thresholds of its own.
LEAST = 100
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_word = re.compile(r"[^\x20\x09-\x0D]").search


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def measures(text: str | None) -> tuple[int, ...]:
    """Values of ``MEASURES``; a null text has none of anything."""
    text = text or ""
    words = _words(text)
    lines = [line for line in text.split("\n") if _word(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measured(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Struct ``row`` of the carried columns (all by default), with ``lang``, ``source`` and a column per measure."""
    inner = docs.select(F.struct(*(carry or docs.columns)).alias("row"), "lang", "source", "text")
    numbers = [StructField(name, LongType()) for name in MEASURES]
    schema = StructType(inner.schema.fields[:3] + numbers)

    def run(batches):
        for batch in batches:
            found = list(zip(*map(measures, batch.column(3).to_pylist()))) or [()] * len(MEASURES)
            columns = batch.columns[:3] + [pa.array(v, pa.int64()) for v in found]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return inner.mapInArrow(run, schema)


def base_failed() -> Column:
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    return (F.col("n_words") < MIN_WORDS) | repeats


def rule_value(rule: Rule) -> Column:
    """Whole-number measure of a rule, null without a denominator."""
    top, bottom = F.col(rule.top) * rule.scale, F.col(rule.bottom)
    return F.when(bottom > 0, F.floor(top / bottom))


def bucket(value: Column) -> Column:
    """Lower end of the value's bucket: its six leading binary digits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(table: DataFrame) -> DataFrame:
    """Counts n by lang, source, rule and bucket over the documents that pass the base."""
    rules = F.array(
        *[F.struct(F.lit(r.name).alias("rule"), rule_value(r).alias("value")) for r in RULES]
    )
    return (
        table.where(~base_failed())
        .select("lang", "source", F.inline(rules))
        .where("value is not null")
        .withColumn("bucket", bucket(F.col("value")))
        .groupBy("lang", "source", "rule", "bucket")
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of each group's merged sketch, from the few buckets it has."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    groups = merged.groupBy(*keys, "rule").agg(ordered.alias("sketch"), F.sum("n").alias("total"))

    def at(quarters: int) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value"))

        def step(state, item):
            seen = state["seen"] + item["n"]
            hit = state["value"].isNull() & (seen * 4 >= F.col("total") * quarters)
            return F.struct(seen.alias("seen"), F.when(hit, item["bucket"]).otherwise(state["value"]).alias("value"))

        return F.aggregate("sketch", begin, step)["value"]

    return groups.select(*keys, "rule", "total", at(1).alias("low"), at(3).alias("high"))


def fences(sketch: DataFrame, reach: int = REACH, least: int = LEAST) -> DataFrame:
    """Per language and source the columns ``<rule>_low`` and ``<rule>_high``."""
    by_source = _quartiles(sketch, ["lang", "source"])
    levels = [
        _quartiles(sketch, ["lang"]).withColumnsRenamed(
            {"total": "total_l", "low": "low_l", "high": "high_l", "lang": "lang_l", "rule": "rule_l"}
        ),
        _quartiles(sketch, []).withColumnsRenamed(
            {"total": "total_a", "low": "low_a", "high": "high_a", "rule": "rule_a"}
        ),
    ]
    table = by_source.join(
        levels[0], F.col("lang").eqNullSafe(F.col("lang_l")) & (F.col("rule") == F.col("rule_l"))
    ).join(levels[1], F.col("rule") == F.col("rule_a"))

    def chosen(name: str) -> Column:
        return (
            F.when(F.col("total") >= least, F.col(name))
            .when(F.col("total_l") >= least, F.col(f"{name}_l"))
            .otherwise(F.col(f"{name}_a"))
        )

    table = table.select("lang", "source", "rule", chosen("low").alias("low"), chosen("high").alias("high"))
    columns = []
    for rule in RULES:
        own = F.col("rule") == rule.name
        slack = reach * F.greatest(F.col("high") - F.col("low"), F.lit(rule.spread))
        low = F.col("low") - slack if rule.both else F.lit(None).cast("long")
        columns.append(F.max(F.when(own, low)).alias(f"{rule.name}_low"))
        columns.append(F.max(F.when(own, F.col("high") + slack)).alias(f"{rule.name}_high"))
    return table.groupBy("lang", "source").agg(*columns)


def within_fences() -> Column:
    """Whether a measured row with joined fences breaks none; a missing fence holds."""
    inside = F.lit(True)
    for rule in RULES:
        value = rule_value(rule)
        over = F.coalesce(value > F.col(f"{rule.name}_high"), F.lit(False))
        under = F.coalesce(value < F.col(f"{rule.name}_low"), F.lit(False))
        inside = inside & ~over & ~under
    return inside


def judged(
    docs: DataFrame, carry: list[str] | None = None, reach: int = REACH, least: int = LEAST
) -> DataFrame:
    """``row`` (the carried columns of ``docs``, all by default), the measures, ``base_failed`` and ``kept``.

    ``docs`` needs text, lang and source; further columns travel inside ``row``, so
    their names cannot clash.  Null and empty texts have no words and fail the base.
    Null languages and sources are groups like others.  Repeated rows are judged, and
    counted, one by one.  An empty table gives none.  Texts are measured whole.
    """
    table = stored(measured(spread(docs), carry), "quality")
    limits = stored(fences(sketches(table), reach, least).coalesce(1), "fences")
    joined = look_up(table, limits, ["lang", "source"], F.col("row"))
    verdict = ~base_failed() & within_fences()
    return joined.select(
        "row", *MEASURES, base_failed().alias("base_failed"), verdict.alias("kept")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    return judged(docs).where("kept").select("row.*")
