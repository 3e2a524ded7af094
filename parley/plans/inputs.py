"""Inputs derived from the supplied tables.

Text inputs the tables lack (requests, model outputs, forecasts) are spelled out
of ``events`` by SQL expressions that both Spark and DuckDB read, so the check
query starts from the same strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import strip, words
from parley.session import spread
from parley.sources.turns import pairs_from_turns


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_from_turns(table(spark, folder, "conversations"))


def dirty_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs damaged in a fixed way per ``row_id``: one kind per rule."""
    token = words(strip(F.col("output")))
    four = F.concat(F.array_join(F.slice(token, 1, 4), " "), F.lit(" "))
    kind = F.col("row_id") % 7
    damaged = (
        F.when(kind == 0, "")
        .when(kind == 1, F.array_join(F.slice(token, 1, 2), " "))
        .when(kind == 2, F.repeat(four, F.lit(6)))
        .when(kind == 3, "http://")
        .when(kind == 4, F.concat(F.regexp_replace("output", r"[.!?;:,]+\z", ""), F.lit(" the")))
        .when(kind == 5, F.col("input"))
        .otherwise(F.col("output"))
    )
    return pairs(spark, folder).withColumn("output", damaged)


# File names as a scraper would make them.
DOCUMENT_NAME = """CASE doc_id % 4
    WHEN 0 THEN concat('https_', source, '_com_', lang, '_', CAST(doc_id AS STRING), '.txt')
    WHEN 1 THEN concat('www.', source, '.org-', lang, '-', CAST(doc_id AS STRING), '.txt')
    WHEN 2 THEN concat(lang, ' notes ', CAST(doc_id AS STRING), '.txt')
    ELSE concat(source, '_', CAST(doc_id AS STRING), '.txt') END"""


def named_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return spread(
        documents.select(
            "doc_id",
            F.expr(DOCUMENT_NAME).alias("name"),
            F.col("text").alias("content"),
            "lang",
            "source",
        ).withColumnRenamed("source", "site")
    )


REQUEST_TEXT = """CASE event_id % 6
    WHEN 0 THEN concat('Show temperature for the next ', CAST(value AS STRING), ' hours as json')
    WHEN 1 THEN concat('give me humidity and pressure over ', CAST(event_id % 90 + 1 AS STRING), ' minutes in CSV')
    WHEN 2 THEN concat(CAST(event_id % 14 + 1 AS STRING), '-day solar forecast')
    WHEN 3 THEN concat('What will the barometer do for user ', CAST(user_id AS STRING), '?')
    WHEN 4 THEN concat(event_type, ' summary table, next ', CAST(event_id % 30 AS STRING), ' hrs')
    ELSE concat('notable temps, ', CAST(event_id % 50 + 1 AS STRING), 'min of light') END"""

REQUEST_BODY = """concat(
    '{',
    CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN '"query": "  ", '
         ELSE concat('"query": " sensor_id=', CAST(user_id AS STRING), ',altitude=', CAST(value AS STRING), '", ') END,
    CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 3 = 0 THEN concat('"duration": "', CAST(value AS STRING), '", ')
         WHEN event_id % 23 = 0 THEN '"duration": "long", ' ELSE concat('"duration": ', CAST(event_id % 40 AS STRING), ', ') END,
    CASE WHEN event_id % 29 = 0 THEN '"interval": -1, ' ELSE '"interval": 0.5, ' END,
    CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '"targets": [], ' WHEN 2 THEN '"targets": ["temp", "humidity"], '
         ELSE CASE WHEN event_id % 5 = 0 THEN '"targets": ["temp", "wind", "rain"], ' ELSE '"targets": null, ' END END,
    '"format": "', CASE WHEN event_id % 11 = 0 THEN 'xml' WHEN event_id % 2 = 0 THEN 'csv' ELSE 'table' END,
    '"}')"""

# The body as a model would write it: clean, in prose, as a dict literal, with a
# trailing comma, cut off, or not at all.
MODEL_OUTPUT = """CASE event_id % 6
    WHEN 0 THEN body
    WHEN 1 THEN concat('Sure! Here it is: ', body, ' Hope that helps {really}.')
    WHEN 2 THEN concat('Answer: ', replace(replace(body, '"', chr(39)), 'null', 'None'), ' Done.')
    WHEN 3 THEN replace(body, '"}', '",}')
    WHEN 4 THEN replace(body, '"}', '"')
    ELSE 'I do not understand the request.' END"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """User requests, request bodies and model outputs, one per event."""
    events = table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "ts", "value"
    )
    return (
        spread(events)
        .withColumn("user_request", F.expr(REQUEST_TEXT))
        .withColumn("body", F.expr(REQUEST_BODY))
        .withColumn("model_output", F.expr(MODEL_OUTPUT))
    )


SENSOR_QUERY = """CASE event_id % 5
    WHEN 0 THEN concat('sensor_id=', CAST(user_id AS STRING))
    WHEN 1 THEN concat(' sensor_id = ', CAST(user_id AS STRING), ', latitude=', CAST(value AS STRING), ',longitude=-105.5')
    WHEN 2 THEN concat('sensor_id=', event_type, ',note=a=b')
    WHEN 3 THEN concat('sensor_id=1,', event_type, ',altitude=2')
    ELSE concat('altitude=1,sensor_id=', CAST(user_id AS STRING), ',altitude=', CAST(value AS STRING)) END"""

PREDICTION_COLUMNS = {
    "sensor_id": "user_id",
    "temp": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END",
    "barometer": "CASE WHEN event_id % 4 = 1 THEN NULL ELSE 1000 + value END",
    "light": "CASE WHEN event_id % 4 = 2 THEN NULL ELSE value * 1000000 END",
    "humidity": "CASE WHEN event_id % 4 = 3 THEN NULL ELSE value * 0.125 END",
}


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    events = spread(table(spark, folder, "events").select("event_id", "ts", "user_id", "value"))
    return events.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"),
        *[F.expr(rule).alias(name) for name, rule in PREDICTION_COLUMNS.items()],
    )


def feed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs as feed lines, some malformed, blank, lacking a key, with half an emoji
    escape, or with a stray byte."""
    record = F.to_json(
        F.struct("input", "output", (F.col("row_id") % 2 == 0).alias("accepted"))
    )
    kind = (F.col("conv_id") + F.col("turn")) % 11
    half = F.concat(F.lit('{"input": "half \\ud83d", "output": "'), F.col("row_id").cast("string"), F.lit('"}'))
    stray = F.concat(F.encode(F.lit('{"input": "caf'), "utf-8"), F.unhex(F.lit("E9")), F.encode(F.lit('", "output": ""}'), "utf-8"))
    line = (
        F.when(kind == 3, "NOT VALID JSON")
        .when(kind == 5, "   ")
        .when(kind == 7, '{"only": "metadata"}')
        .when(kind == 9, F.concat(record, F.lit(" trailing")))
        .when(kind == 1, half)
        .when(kind == 2, stray.cast("string"))
        .otherwise(record)
    )
    return pairs(spark, folder).select(
        "row_id", "conv_id", "turn", F.floor(F.col("conv_id") / 50).alias("shard"), line.alias("line")
    )


def write_feed(spark: SparkSession, folder: str, path: str) -> None:
    """The feed as text files, one per shard of 50 conversations, in row order.

    A shard with many rows is as large a file as it is in any feed; the sort spills.
    """
    lines = feed_lines(spark, folder).select("shard", "row_id", "line")
    ordered = lines.repartition("shard").sortWithinPartitions("shard", "row_id")
    ordered.drop("row_id").write.partitionBy("shard").text(path)


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """Chat sessions: prompt, response and the reviewer's correction."""
    quits = (F.col("conv_id") % 3 == 0) & (F.col("turn") >= 4)
    return pairs(spark, folder).select(
        "row_id",
        "conv_id",
        "turn",
        F.when(quits, " Quit\n").when(F.col("conv_id") % 5 == 4, "  ").otherwise(
            F.concat(F.lit("  "), "input")
        ).alias("prompt"),
        F.col("output").alias("response"),
        F.when((F.col("conv_id") + F.floor(F.col("turn") / 2)) % 2 == 0, " \n ")
        .otherwise(F.concat(F.lit(" Better: "), "input"))
        .alias("correction"),
    )


def write_growing_feed(spark: SparkSession, folder: str, path: str, rounds: int) -> None:
    """The feed's files as they stand after so many of three rounds, one per shard.

    Each round makes them longer; only the last one ends their last line.  A file is put in
    place whole, so a task that runs twice changes nothing.
    """
    lines = feed_lines(spark, folder).select("shard", (F.col("row_id") % 3).alias("part"), "row_id", "line")
    lines = lines.where(F.col("part") < rounds).repartition("shard").sortWithinPartitions("shard", "part", "row_id")

    def write(batches):
        from parley.sources.growing import opened

        store, place = opened(path)
        store.create_dir(place)
        shard, out = None, None

        def close():
            out.write(b"\n" if rounds == 3 else b"")
            out.close()
            store.move(f"{place}/_{shard}", f"{place}/shard={shard}.jsonl")

        for batch in batches:
            for number, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != shard:
                    if out:
                        close()
                    shard, out = number, store.open_output_stream(f"{place}/_{number}")
                    out.write(line)
                else:
                    out.write(b"\n" + line)
        if out:
            close()
        yield from ()

    raw = lines.select("shard", F.col("line").cast("binary").alias("line"))
    raw.mapInArrow(write, "shard BIGINT").count()


def write_text_files(texts: DataFrame, path: str) -> None:
    """One file per row (``folder``, ``name``, ``content``), written by the tasks that have them."""

    def write(batches):
        from parley.sources.growing import opened

        store, place = opened(path)
        made = set()
        for batch in batches:
            for folder, name, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if folder not in made:
                    store.create_dir(f"{place}/{folder}")
                    made.add(folder)
                with store.open_output_stream(f"{place}/{folder}/{name}") as out:
                    out.write(content)
        yield from ()

    raw = texts.select("folder", "name", F.col("content").cast("binary").alias("content"))
    raw.mapInArrow(write, "name STRING").count()
