"""Training text, token rows, batches, and generation around a model function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from parley import fixed_values as fixed
from parley.session import computed_once
from parley.functions.text import head, strip
from parley.operators.numbering import with_position

IGNORED_LABEL = -100


def training_text(asked: Column, said: Column) -> Column:
    def shown(text: Column) -> Column:
        return F.coalesce(text, F.lit("None"))

    return F.concat(F.lit("User: "), shown(asked), F.lit("\nAssistant: "), shown(said))


def get_batch(df: DataFrame, batch_size: int, start: int = 0, key: str = "row_id") -> DataFrame:
    """Rows at positions start .. start + batch_size - 1; short at the end."""
    return with_position(df, key, start, batch_size)


def assign_batches(df: DataFrame, batch_size: int, key: str = "row_id") -> DataFrame:
    """Add ``position`` and ``batch_no`` (0-based) in ``key`` order."""
    return with_position(df, key).withColumn(
        "batch_no", F.floor(F.col("position") / batch_size).cast("bigint")
    )


def planned_steps(
    df: DataFrame, batch_size: int, epochs: int = 3, max_steps: int = -1
) -> DataFrame:
    """One row: rows, steps per epoch and planned steps; ``max_steps`` > 0 overrides."""
    per_epoch = F.ceil(F.col("rows") / batch_size).cast("bigint")
    planned = F.lit(max_steps).cast("bigint") if max_steps > 0 else F.col("steps_per_epoch") * epochs
    return (
        df.agg(F.count("*").alias("rows"))
        .withColumn("steps_per_epoch", per_epoch)
        .withColumn("planned_steps", planned)
    )


Tokenizer = Callable[[list[str]], list[list[int]]]


def byte_tokenizer(texts: list[str]) -> list[list[int]]:
    """UTF-8 bytes shifted by three, leaving 0-2 for special tokens."""
    return [[byte + 3 for byte in text.encode("utf-8")] for text in texts]


def token_rows(
    df: DataFrame,
    text_col: str = "text",
    tokenizer: Tokenizer = byte_tokenizer,
    max_length: int = fixed.MAX_TOKENS,
    pad_id: int = 0,
) -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``labels``, all ``max_length`` long.

    Only the truncated ids cross from Python; padding, mask and labels are native.
    Labels repeat the ids, with every pad id ignored.
    """

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            ids = tokenizer(texts.fillna("").tolist())
            yield pd.Series([row[:max_length] for row in ids], dtype="object")

    ids = F.col("_ids")
    missing = F.lit(max_length) - F.size(ids)

    def padded(values: Column, filler: int) -> Column:
        return F.concat(values, F.array_repeat(F.lit(filler), missing))

    label = F.transform(
        ids, lambda token: F.when(token == pad_id, IGNORED_LABEL).otherwise(token)
    )
    text = F.col(text_col)
    if tokenizer is byte_tokenizer:
        # A character has at least one byte, so no more of them can be needed.
        text = head(text, max_length)
    encoded = computed_once(df, "_ids", encode(text))
    return encoded.select(
        *df.columns,
        padded(ids, pad_id).alias("input_ids"),
        padded(F.array_repeat(F.lit(1), F.size(ids)), 0).alias("attention_mask"),
        padded(label, IGNORED_LABEL).alias("labels"),
    )


def normal_prompt(text: Column, max_chars: int | None = fixed.MAX_PROMPT_CHARS) -> Column:
    """Cut to the prompt limit, if there is one, and put into the chat frame."""
    cut = text if max_chars is None else head(text, max_chars)
    return F.concat(F.lit("User: "), cut, F.lit("\nAssistant:"))


def clean_response(raw: Column) -> Column:
    """Text after the last ``Assistant:``, stripped."""
    return strip(F.substring_index(raw, "Assistant:", -1))


Model = Callable[[list[str]], list[str]]


def batch_generate(
    df: DataFrame,
    model: Callable[[], Model] | Model,
    prompt_col: str = "prompt",
    factory: bool = False,
    max_chars: int | None = fixed.MAX_PROMPT_CHARS,
) -> DataFrame:
    """Add ``response``: framed prompt, model function, cleaned output, row by row.

    With ``factory`` the argument builds the model function, once per Python
    worker and task, so that weights load where they are used.
    """

    @F.pandas_udf(StringType())
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model() if factory else model
        for prompts in batches:
            yield pd.Series(run(prompts.tolist()), dtype="object")

    framed = normal_prompt(F.col(prompt_col), max_chars)
    answered = computed_once(df, "_raw", generate(framed))
    return answered.select(*df.columns, clean_response(F.col("_raw")).alias("response"))
