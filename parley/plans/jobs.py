"""End-to-end jobs, as functions for spark-submit scripts and notebooks."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parley import fixed_values as fixed
from parley.operators.forecast import resolve_requests, split_requests
from parley.operators.prep import Tokenizer, byte_tokenizer, token_rows, training_text
from parley.operators.quality import (
    QualityConfig,
    quality_report,
    quality_totals,
    score_pairs,
)
from parley.operators.scrape import describe, scrape_counts
from parley.session import work_folder
from parley.sources.readers import read_text_folder, unlisted_files
from parley.sources.writers import write_jsonl

logger = logging.getLogger(__name__)


class QualityTooLow(ValueError):
    """Raised when the training gate blocks a dataset."""


def validate(
    pairs: DataFrame,
    scored_path: str,
    config: QualityConfig = QualityConfig(),
    filtered_path: str | None = None,
) -> DataFrame:
    """Score pairs once, write the verdicts, and return the one-row report.

    The rules run in a single pass that writes whole rows, flags and issues to
    ``scored_path``, partitioned by ``is_valid``.  With ``filtered_path`` the valid
    partition is read back and written there, not validated again.
    """
    spark = pairs.sparkSession
    scored = score_pairs(pairs, config)
    scored.write.mode("overwrite").partitionBy("is_valid").parquet(scored_path)
    written = spark.read.schema(scored.schema).parquet(scored_path)
    if filtered_path is not None:
        valid = written.where("is_valid").select(*pairs.columns)
        write_jsonl(valid, filtered_path, mode="overwrite")
    return quality_report(written)


def exit_code(report: DataFrame) -> int:
    """0 for acceptable data, 1 below half valid."""
    return report.select("exit_code").first()[0]


def scrape(
    spark: SparkSession, folder: str, output_path: str, **options
) -> dict[str, int]:
    """Text folder to pairs; returns files found, processed, skipped and unlisted.

    Unlisted are those that Spark's listing leaves out and that are read apart.

    The counts are observed while writing, so the files are read once.  No usable
    file is an error.
    """
    described = describe(read_text_folder(spark, folder), **options)
    seen = Observation("scrape")
    counted = described.select("skip_reason", "prompt", "cleaned").observe(seen, *scrape_counts())
    pairs = counted.where(F.col("skip_reason").isNull()).select(
        F.col("prompt").alias("input"), F.col("cleaned").alias("output")
    )
    write_jsonl(pairs, output_path, mode="overwrite")
    if not seen.get["processed"]:
        raise ValueError(f"No files were processed successfully in {folder}")
    return {**seen.get, "unlisted": len(unlisted_files(spark, folder))}


def prepare_training(
    pairs: DataFrame,
    output_path: str,
    tokenizer: Tokenizer = byte_tokenizer,
    max_length: int = fixed.MAX_TOKENS,
    pad_id: int = 0,
    config: QualityConfig = QualityConfig(),
    force: bool = False,
) -> DataFrame:
    """Gate on quality, then write token rows; returns the written table."""
    spark = pairs.sparkSession
    score = quality_totals(score_pairs(pairs, config)).select("quality_score").first()[0]
    if score < fixed.ACCEPTABLE_SCORE and not force:
        raise QualityTooLow(f"quality score {score:.1%}: filter the data or force")
    if score < fixed.GOOD_SCORE:
        logger.warning("Quality score %.1f%%: consider filtering", score * 100)
    texts = pairs.withColumn("text", training_text(F.col("input"), F.col("output")))
    rows = token_rows(texts.select("text"), "text", tokenizer, max_length, pad_id)
    rows.drop("text").write.mode("overwrite").parquet(output_path)
    return spark.read.parquet(output_path)


def resolve(requests: DataFrame, valid_path: str, quarantine_path: str) -> None:
    """Resolve requests once, then write usable ones and failures apart.

    What was resolved is written once and read twice, so a lost executor costs a read.
    """
    spark = requests.sparkSession
    folder = work_folder(spark, "resolved")
    resolve_requests(requests).write.parquet(folder)
    valid, failed = split_requests(spark.read.parquet(folder))
    valid.write.mode("overwrite").parquet(valid_path)
    failed.write.mode("overwrite").parquet(quarantine_path)
