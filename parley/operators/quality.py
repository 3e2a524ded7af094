"""Pair quality: rules, verdicts and the dataset report.

``score_pairs`` adds one boolean per rule, the issue list and the verdict in a
narrow projection (no shuffle).  ``quality_report`` reduces those booleans in one
partial/final aggregation, so only counters are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed_values as fixed
from parley.functions.repetition import repetition_score
from parley.session import computed_once
from parley.functions.text import head, strip, word_count, words

RULES = ("empty", "repetitive", "short", "gibberish", "incomplete", "echo")


@dataclass(frozen=True)
class QualityConfig:
    """Which rules run, and their thresholds.  The empty rule always runs."""

    repetitive: bool = True
    short: bool = True
    gibberish: bool = True
    incomplete: bool = True
    echo: bool = True
    repetition_threshold: float = fixed.REPETITION_THRESHOLD
    min_words: int = fixed.MIN_WORDS
    # Extra rules: name -> function of (input, output) giving a boolean column.
    # The name is also the issue text.
    extra: Mapping[str, Callable[[Column, Column], Column]] = field(default_factory=dict)

    def runs(self, rule: str) -> bool:
        return rule == "empty" or getattr(self, rule)


def is_empty(output: Column) -> Column:
    return F.coalesce(strip(output) == "", F.lit(True))


def is_repetitive(output: Column, threshold: float = fixed.REPETITION_THRESHOLD) -> Column:
    return F.coalesce(repetition_score(output) > threshold, F.lit(False))


def is_short(stripped: Column, min_words: int = fixed.MIN_WORDS) -> Column:
    return word_count(stripped, min_words) < min_words


def is_gibberish(output: Column, stripped: Column) -> Column:
    letters = F.length(F.regexp_replace(output, r"\P{L}+", ""))
    # Only the plain space is left out; line breaks count as characters.
    visible = F.length(F.replace(output, F.lit(" "), F.lit("")))
    return (
        (stripped == "")
        | stripped.isin(fixed.BARE_SCHEMES)
        | F.coalesce(letters / F.nullif(visible, F.lit(0)) < fixed.MIN_LETTER_SHARE, F.lit(True))
    )


def is_incomplete(stripped: Column) -> Column:
    last = F.substring_index(stripped, " ", -1)
    dangling = (last != stripped) & F.lower(last).isin(fixed.DANGLING_WORDS)
    # A final fragment of one or two letters, leading marks aside, without a
    # closing mark after it.
    marks = r"[.,!?;:'\")\]}]*"
    fragment = stripped.rlike(fixed.WHITESPACE_CLASS + marks + r"\p{L}{1,2}\z")
    return (stripped != "") & (dangling | (fragment & (word_count(stripped, 4) > 3)))


def is_echo(asked: Column, said: Column, asked_words: Column, said_words: Column) -> Column:
    """Both texts lowered and stripped, with their words."""

    def opening(tokens: Column) -> Column:
        return F.array_join(F.slice(tokens, 1, 8), " ")

    first = opening(asked_words)
    half = F.substring(first, F.lit(1), F.floor(F.length(first) / 2).cast("int"))
    starts_alike = (
        (F.size(asked_words) > 3)
        & (F.size(said_words) > 3)
        & F.startswith(opening(said_words), half)
    )
    known = F.size(F.array_distinct(asked_words))
    shared = F.size(F.array_intersect(asked_words, said_words))
    overlap = (known > 3) & (shared / F.nullif(known, F.lit(0)) > fixed.ECHO_OVERLAP)
    repeats = (F.length(asked) > 10) & (F.contains(said, asked) | overlap)
    return starts_alike | F.coalesce(repeats, F.lit(False))


def score_pairs(df: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Add ``is_<rule>`` flags, ``issues`` and ``is_valid`` to (input, output) rows.

    Stripped texts and word arrays are projected once and shared by the rules;
    those of a rule switched off are pruned from the plan.
    """
    asked, said = F.col("input"), F.col("output")
    # Rules other than "empty" look at non-empty strings only; whitespace counts.
    has_output = F.coalesce(said != "", F.lit(False))
    has_input = F.coalesce(asked != "", F.lit(False))
    prepared = df
    if config.runs("repetitive"):
        prepared = computed_once(prepared, "_repetition", repetition_score(said))
    # Only the echo rule needs lower-case words, and only of rows with an input.
    prepared = prepared.withColumns(
        {
            "_said": strip(said),
            "_asked_lower": F.when(has_input, strip(F.lower(asked))),
            "_said_lower": F.when(has_input, strip(F.lower(said))),
        }
    ).withColumns(
        {"_asked_words": words(F.col("_asked_lower")), "_said_words": words(F.col("_said_lower"))}
    )
    stripped = F.col("_said")
    echo = is_echo(*[F.col(f"_{n}") for n in ("asked_lower", "said_lower", "asked_words", "said_words")])
    flags = {
        "empty": F.coalesce(stripped == "", F.lit(True)),
        "repetitive": F.coalesce(F.col("_repetition") > config.repetition_threshold, F.lit(False))
        if config.runs("repetitive")
        else F.lit(False),
        "short": has_output & is_short(stripped, config.min_words),
        "gibberish": has_output & is_gibberish(said, stripped),
        "incomplete": has_output & is_incomplete(stripped),
        "echo": has_output & has_input & echo,
    }
    columns = {
        f"is_{rule}": flags[rule] if config.runs(rule) else F.lit(False) for rule in RULES
    }
    kept = [F.col(name) for name in df.columns]
    flagged = prepared.select(*kept, *[column.alias(name) for name, column in columns.items()])
    issues = [F.when(F.col(f"is_{rule}"), fixed.ISSUE_TEXT[rule]) for rule in RULES]
    issues += [F.when(rule(asked, said), name) for name, rule in config.extra.items()]
    listed = flagged.withColumn("issues", F.array_compact(F.array(*issues)))
    return listed.withColumn("is_valid", F.size("issues") == 0)


def filter_valid(df: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Rows without any issue, with their original columns."""
    return score_pairs(df, config).where("is_valid").select(*df.columns)


def quality_totals(scored: DataFrame, *by: str) -> DataFrame:
    """Counts, score, verdict and advice, for all rows or per ``by`` column."""
    counts = [F.count_if(f"is_{rule}").alias(key) for rule, key in fixed.SUMMARY_KEYS.items()]
    totals = scored.groupBy(*by).agg(
        F.count("*").alias("total_conversations"),
        F.count_if("is_valid").alias("valid_conversations"),
        *counts,
    )
    total = F.col("total_conversations")
    return (
        totals.withColumn("invalid_conversations", total - F.col("valid_conversations"))
        .withColumn(
            "quality_score",
            F.coalesce(F.col("valid_conversations") / F.nullif(total, F.lit(0)), F.lit(0.0)),
        )
        .withColumn("recommendations", _advice())
        .withColumn("verdict", verdict(F.col("quality_score")))
        .withColumn("exit_code", (F.col("quality_score") < fixed.ACCEPTABLE_SCORE).cast("int"))
    )


def verdict(score: Column) -> Column:
    return (
        F.when(score >= fixed.GOOD_SCORE, "GOOD")
        .when(score >= fixed.ACCEPTABLE_SCORE, "ACCEPTABLE")
        .otherwise("CRITICAL")
    )


def _advice() -> Column:
    total, score = F.col("total_conversations"), F.col("quality_score")

    def lines(texts: list[str]) -> Column:
        return F.array(*[F.lit(text) for text in texts])

    def noted(key: str, share: float, text: str) -> Column:
        return F.when(F.col(key) > total * share, F.format_string(text, F.col(key)))

    level = (
        F.when(score < fixed.ACCEPTABLE_SCORE, lines(fixed.ADVICE_CRITICAL))
        .when(score < fixed.GOOD_SCORE, lines(fixed.ADVICE_WARNING))
        .otherwise(lines([fixed.ADVICE_OK]))
    )
    details = F.array_compact(
        F.array(
            noted("repetitive_outputs", 0.2, fixed.ADVICE_REPETITIVE),
            noted("empty_outputs", 0.0, fixed.ADVICE_EMPTY),
            noted("gibberish_outputs", 0.1, fixed.ADVICE_GIBBERISH),
            noted("echo_outputs", 0.1, fixed.ADVICE_ECHO),
            noted("incomplete_outputs", 0.1, fixed.ADVICE_INCOMPLETE),
        )
    )
    return F.when(total == 0, lines([fixed.ADVICE_NO_DATA])).otherwise(F.concat(level, details))


def problematic_examples(scored: DataFrame, count: int = fixed.EXAMPLE_COUNT) -> DataFrame:
    """The first ``count`` invalid rows by ``row_id``, texts cut for display."""
    return (
        scored.where(~F.col("is_valid"))
        .select("row_id", "input", "output", "issues")
        .orderBy("row_id")
        .limit(count)
        .select(
            F.col("row_id").alias("index"),
            head(F.coalesce("input", F.lit("")), fixed.EXAMPLE_CHARS).alias("input"),
            head(F.coalesce("output", F.lit("")), fixed.EXAMPLE_CHARS).alias("output"),
            "issues",
        )
    )


def quality_report(scored: DataFrame) -> DataFrame:
    """One row: totals, issue map, examples and advice (same columns when empty).

    Reads ``scored`` twice, for counters and for the first invalid rows, so at
    scale pass a written table (see ``jobs.validate``): the first read then takes
    the boolean columns only, the second the invalid partition.  The handful of
    example rows is folded in by a union and one more tiny aggregation.
    """
    totals = quality_totals(scored)
    example = F.struct("index", "input", "output", "issues")
    examples = problematic_examples(scored).select(example.alias("example"))
    both = totals.unionByName(examples, allowMissingColumns=True)
    summary = F.map_from_arrays(
        F.array(*[F.lit(key) for key in fixed.SUMMARY_KEYS.values()]),
        F.array(*[F.col(key) for key in fixed.SUMMARY_KEYS.values()]),
    )
    carried = [name for name in totals.columns]
    return both.agg(
        *[F.max(name).alias(name) for name in carried],
        F.array_sort(F.collect_list("example")).alias("problematic_examples"),
    ).withColumn("issue_summary", summary)


def issue_summary(totals: DataFrame, *by: str) -> DataFrame:
    """Totals turned long: one row per rule key."""
    return totals.unpivot(
        list(by), list(fixed.SUMMARY_KEYS.values()), "issue", "conversations"
    )


def issue_display(totals: DataFrame) -> DataFrame:
    """Non-zero issue counts under their display names."""
    return (
        issue_summary(totals)
        .where("conversations > 0")
        .withColumn("issue", F.initcap(F.replace("issue", F.lit("_"), F.lit(" "))))
    )


def training_gate(totals: DataFrame, force: bool = False) -> DataFrame:
    """Whether training may start: blocked below 0.5 unless forced, warned below 0.7."""
    score = F.col("quality_score")
    blocked = (score < fixed.ACCEPTABLE_SCORE) & F.lit(not force)
    return totals.select(
        "quality_score",
        F.when(blocked, "blocked")
        .when(score < fixed.GOOD_SCORE, "warn")
        .otherwise("go")
        .alias("gate"),
    )
