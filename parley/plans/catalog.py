"""Every registered query: name to function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.jsontext import extract_json
from parley.functions.repetition import repetition_score
from parley.functions.text import strip, words
from parley.operators import feedback, forecast, numbering, prep, quality, scrape
from parley.plans import inputs, jobs
from parley.session import spread, work_folder
from parley.sources import framing, readers, writers
from parley.sources.files import Store
from parley.sources.turns import pairs_from_turns
from parley.streaming.feedback_stream import FailsOnce, FeedbackStream
from parley.streaming.flushing import CountedLogStream
from parley.streaming.windows import feedback_windows, late_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(name: str, separator: str = " | ") -> F.Column:
    return F.array_join(name, separator).alias(name)


# -- pairs and their quality --------------------------------------------------


@query
def pairs(spark, folder):
    return inputs.pairs(spark, folder)


@query
def pairs_large_ids(spark, folder):
    """Pairs of conversations with ids beyond 32 bits and below zero, in order."""
    turns = inputs.table(spark, folder, "conversations")
    large = turns.withColumn("conv_id", (F.col("conv_id") - 20) * 2**33 + F.col("conv_id"))
    pairs_out = pairs_from_turns(large).select("conv_id", "turn", "input", "output")
    return numbering.with_position_by(pairs_out, "conv_id", "turn")


@query
def training_text(spark, folder):
    return inputs.pairs(spark, folder).select(
        "row_id", prep.training_text(F.col("input"), F.col("output")).alias("text")
    )


@query
def get_batch(spark, folder):
    return prep.get_batch(inputs.pairs(spark, folder), batch_size=25, start=40)


@query
def batch_assignment(spark, folder):
    numbered = prep.assign_batches(inputs.pairs(spark, folder).select("row_id"), batch_size=4)
    return numbered.select("row_id", "position", "batch_no")


@query
def training_steps(spark, folder):
    return prep.planned_steps(inputs.pairs(spark, folder), batch_size=4, epochs=3)


@query
def dataset_size(spark, folder):
    return inputs.pairs(spark, folder).agg(F.count("*").alias("conversations"))


def _rule(name: str, rule: Callable[[], F.Column]) -> None:
    def run(spark, folder):
        return inputs.dirty_pairs(spark, folder).select("row_id", rule().alias(name))

    QUERIES[f"rule_{name}"] = run


_rule("empty", lambda: quality.is_empty(F.col("output")))
_rule("repetitive", lambda: quality.is_repetitive(F.col("output")))
_rule("short", lambda: quality.is_short(strip(F.col("output"))))
_rule("gibberish", lambda: quality.is_gibberish(F.col("output"), strip(F.col("output"))))
_rule("incomplete", lambda: quality.is_incomplete(strip(F.col("output"))))


@query
def rule_echo(spark, folder):
    lowered = inputs.dirty_pairs(spark, folder).select(
        "row_id",
        strip(F.lower("input")).alias("asked"),
        strip(F.lower("output")).alias("said"),
    )
    asked, said = F.col("asked"), F.col("said")
    split = lowered.withColumns({"asked_words": words(asked), "said_words": words(said)})
    echo = quality.is_echo(asked, said, F.col("asked_words"), F.col("said_words"))
    return split.select("row_id", echo.alias("echo"))


@query
def repetition_scores(spark, folder):
    return inputs.dirty_pairs(spark, folder).select(
        "row_id", repetition_score(F.col("output")).alias("score")
    )


def _document_pairs(spark, folder) -> DataFrame:
    documents = inputs.table(spark, folder, "documents")
    shaped = documents.select(
        F.col("doc_id").alias("row_id"),
        F.lit("").alias("input"),
        F.col("text").alias("output"),
        "lang",
        "source",
    )
    return spread(shaped)


@query
def document_repetition(spark, folder):
    documents = spread(inputs.table(spark, folder, "documents").select("doc_id", "text"))
    return documents.select("doc_id", repetition_score(F.col("text")).alias("score"))


@query
def document_issues(spark, folder):
    scored = quality.score_pairs(_document_pairs(spark, folder))
    return scored.select(F.col("row_id").alias("doc_id"), joined("issues"), "is_valid")


@query
def quality_by_source(spark, folder):
    totals = quality.quality_totals(quality.score_pairs(_document_pairs(spark, folder)), "source")
    return totals.withColumn("recommendations", F.array_join("recommendations", " | "))


def _scored(spark, folder) -> DataFrame:
    return quality.score_pairs(inputs.dirty_pairs(spark, folder))


@query
def issues(spark, folder):
    return _scored(spark, folder).select("row_id", joined("issues"), "is_valid")


@query
def issues_some_rules(spark, folder):
    config = quality.QualityConfig(repetitive=False, incomplete=False, min_words=6)
    scored = quality.score_pairs(inputs.dirty_pairs(spark, folder), config)
    return scored.select("row_id", joined("issues"), "is_valid")


@query
def filter_valid(spark, folder):
    return quality.filter_valid(inputs.dirty_pairs(spark, folder)).select(
        "row_id", "input", "output"
    )


@query
def quality_report(spark, folder):
    report = jobs.validate(inputs.dirty_pairs(spark, folder), work_folder(spark, "scored"))
    return report.select(
        "total_conversations",
        "valid_conversations",
        "invalid_conversations",
        "quality_score",
        *quality.fixed.SUMMARY_KEYS.values(),
        joined("recommendations"),
        "verdict",
        "exit_code",
        F.array_join(F.transform("problematic_examples", lambda e: e["index"].cast("string")), ",").alias(
            "example_rows"
        ),
    )


@query
def issue_summary(spark, folder):
    return quality.issue_summary(quality.quality_totals(_scored(spark, folder)))


@query
def issue_display(spark, folder):
    return quality.issue_display(quality.quality_totals(_scored(spark, folder)))


@query
def problematic_examples(spark, folder):
    examples = quality.problematic_examples(_scored(spark, folder))
    return examples.select("index", "input", "output", joined("issues"))


@query
def recommendations(spark, folder):
    totals = quality.quality_totals(_scored(spark, folder))
    return totals.select(F.posexplode("recommendations").alias("line_no", "recommendation"))


@query
def training_gate(spark, folder):
    return quality.training_gate(quality.quality_totals(_scored(spark, folder)))


# -- scraped text to pairs ----------------------------------------------------


def _documents(spark, folder) -> DataFrame:
    return inputs.named_documents(spark, folder)


@query
def topic_from_content(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", scrape.topic_from_content(F.col("content")).alias("topic")
    )


@query
def topic_from_filename(spark, folder):
    named = inputs.table(spark, folder, "documents").select(
        "doc_id", F.expr(inputs.DOCUMENT_NAME).alias("name")
    )
    return named.select("doc_id", scrape.topic_from_filename(F.col("name")).alias("topic"))


@query
def document_source(spark, folder):
    named = inputs.table(spark, folder, "documents").select(
        "doc_id", F.expr(inputs.DOCUMENT_NAME).alias("name")
    )
    return named.select("doc_id", scrape.source_of(F.col("name")).alias("source"))


@query
def page_source(spark, folder):
    name = F.concat(F.regexp_replace("url", "[^A-Za-z0-9]+", "_"), F.lit(".txt"))
    pages = inputs.table(spark, folder, "pages")
    return pages.select(
        "page_id",
        scrape.source_of(name).alias("source"),
        scrape.topic_from_filename(name).alias("topic"),
    )


@query
def clean_content(spark, folder):
    content = F.col("content")
    return _documents(spark, folder).select(
        "doc_id",
        scrape.clean_content(content).alias("cleaned"),
        scrape.clean_content(content, remove_first_line=True).alias("without_title"),
    )


@query
def clean_page_text(spark, folder):
    """Web artefacts sit in the pages: the same cleaning over raw page text."""
    pages = spread(inputs.table(spark, folder, "pages").select("page_id", "html"))
    return pages.select("page_id", scrape.clean_content(F.col("html")).alias("cleaned"))


@query
def content_labels(spark, folder):
    described = scrape.describe(_documents(spark, folder))
    return described.select("doc_id", "content_type", "category")


@query
def template_choice(spark, folder):
    named = inputs.table(spark, folder, "documents").select(
        "doc_id", F.expr(inputs.DOCUMENT_NAME).alias("name")
    )
    return named.select("doc_id", scrape.choose_template(F.col("name"), seed="7").alias("template_no"))


@query
def scrape_pairs(spark, folder):
    return scrape.scrape_pairs(_documents(spark, folder), keep=("doc_id",), seed="7")


@query
def scrape_pairs_template(spark, folder):
    template = "What is {topic} from {source}? ({content_type}, {category}, {filename})"
    return scrape.scrape_pairs(_documents(spark, folder), keep=("doc_id",), template=template)


@query
def scrape_stats(spark, folder):
    return scrape.scrape_stats(_documents(spark, folder))


# -- forecast requests --------------------------------------------------------


@query
def fallback_request(spark, folder):
    fields = forecast.heuristic_request(F.col("user_request"))
    requests = inputs.requests(spark, folder)
    columns = [column.alias(name) for name, column in fields.items()]
    return requests.select("event_id", *columns).withColumn("targets", F.array_join("targets", ","))


@query
def extracted_json(spark, folder):
    requests = inputs.requests(spark, folder)
    read = requests.withColumn("found", extract_json(F.col("model_output")))
    value = F.col("found.request_json")
    return read.select(
        "event_id",
        F.get_json_object(value, "$.query").alias("query"),
        F.get_json_object(value, "$.duration").alias("duration"),
        F.get_json_object(value, "$.format").alias("format"),
        F.col("found.parse_error").alias("parse_error"),
    )


@query
def validate_request(spark, folder):
    checked = forecast.validate_requests(inputs.requests(spark, folder), "body")
    return checked.select(
        "event_id",
        F.when(F.col("error").isNull(), F.col("query")).alias("query"),
        F.when(F.col("error").isNull(), F.col("duration")).alias("duration"),
        F.when(F.col("error").isNull(), F.col("interval")).alias("interval"),
        F.when(F.col("error").isNull(), F.col("format")).alias("format"),
        F.when(F.col("error").isNull(), F.array_join("targets", ",")).alias("targets"),
        "error",
    )


@query
def resolve_request(spark, folder):
    resolved = forecast.resolve_requests(inputs.requests(spark, folder))
    return resolved.select(
        "event_id",
        "query",
        "duration",
        "interval",
        "format",
        F.array_join("targets", ",").alias("targets"),
        "request_source",
        "error",
    )


@query
def parse_query_string(spark, folder):
    events = spread(inputs.table(spark, folder, "events").select("event_id", "user_id", "event_type", "value"))
    parsed = forecast.parse_query(events.select("event_id", F.expr(inputs.SENSOR_QUERY).alias("query")))
    return parsed.select(
        "event_id",
        F.explode_outer("query_map").alias("key", "value"),
        F.col("query_error"),
    ).select(
        "event_id", "key", F.col("value.text").alias("text"), F.col("value.number").alias("number"),
        "query_error",
    )


@query
def predictor_units(spark, folder):
    fields = forecast.heuristic_request(F.col("user_request"))
    requests = inputs.requests(spark, folder).select(
        "event_id", fields["duration"].alias("duration"), (F.col("value") / 7).alias("interval")
    )
    return forecast.predictor_units(requests).select(
        "event_id", "duration_minutes", "interval_seconds"
    )


@query
def time_grid(spark, folder):
    fields = forecast.heuristic_request(F.col("user_request"))
    requests = inputs.requests(spark, folder).select(
        "event_id",
        F.date_trunc("second", "ts").alias("start"),
        fields["duration"].alias("duration"),
        (F.lit(1.0) + F.col("event_id") % 3).alias("interval"),
    )
    grid = forecast.time_grid(requests, "start")
    return grid.select(
        "event_id", "step", F.date_format("predicted_at", "yyyy-MM-dd HH:mm:ss").alias("predicted_at")
    )


def _lines(spark, folder, fmt: str, targets=None) -> DataFrame:
    lines = forecast.format_predictions(
        inputs.predictions(spark, folder).drop("event_id"), fmt, targets
    )
    return lines.select("line_kind", "line")


@query
def predictions_csv(spark, folder):
    return _lines(spark, folder, "csv")


@query
def predictions_csv_targets(spark, folder):
    return _lines(spark, folder, "csv", ["humidity", "temp"])


@query
def predictions_table(spark, folder):
    return _lines(spark, folder, "table")


@query
def predictions_table_by_sensor(spark, folder):
    rows = inputs.predictions(spark, folder).drop("event_id")
    return forecast.format_predictions(rows, "table", ["temp"], by=("sensor_id",)).select(
        "sensor_id", "line_kind", "line"
    )


@query
def predictions_json(spark, folder):
    columns = ["datetime", "sensor_id", "temp", "barometer", "light", "humidity"]
    line = forecast.prediction_json(inputs.predictions(spark, folder).select(*columns))
    return inputs.predictions(spark, folder).select("event_id", line.alias("line"))


@query
def report_prompt(spark, folder):
    """One report per sensor and day over all its predictions."""
    rows = inputs.predictions(spark, folder).withColumn("day", F.left("datetime", F.lit(10)))
    request = F.concat(F.lit("sensor "), F.col("sensor_id").cast("string"), F.lit(" on "), F.col("day"))
    return forecast.forecast_reports(rows, ["sensor_id", "day"], request, "Describe the forecast.", ["temp"])


# -- training rows and generation ---------------------------------------------


@query
def token_rows(spark, folder):
    texts = training_text(spark, folder)
    rows = prep.token_rows(texts, max_length=512)
    return rows.select(
        "row_id",
        joined("input_ids", " "),
        joined("attention_mask", " "),
        joined("labels", " "),
    )


@query
def prompt_text(spark, folder):
    documents = inputs.table(spark, folder, "documents")
    return documents.select("doc_id", prep.normal_prompt(F.col("text")).alias("prompt"))


@query
def response_text(spark, folder):
    raw = F.concat(F.lit(" User: "), "input", F.lit("\nAssistant: "), "output", F.lit(" \n"))
    return inputs.pairs(spark, folder).select("row_id", prep.clean_response(raw).alias("response"))


def word_counting_model(prompts: list[str]) -> list[str]:
    """Stand-in for a language model: answers with the length of what it read."""
    return [f"{prompt} I read {len(prompt.split())} words. \n" for prompt in prompts]


@query
def batch_generate(spark, folder):
    prompts = spread(
        inputs.table(spark, folder, "documents").select("doc_id", F.col("text").alias("prompt"))
    )
    answered = prep.batch_generate(prompts, word_counting_model)
    return answered.select("doc_id", "response")


# -- feedback -----------------------------------------------------------------


@query
def open_prompts(spark, folder):
    kept = feedback.open_prompts(inputs.exchanges(spark, folder), session="conv_id")
    return kept.select("row_id", "prompt")


@query
def feedback_label(spark, folder):
    kept = feedback.open_prompts(inputs.exchanges(spark, folder), session="conv_id")
    return feedback.label_feedback(kept).select("row_id", "input", "output", "accepted")


@query
def feed_records(spark, folder):
    parsed = feedback.parsed_lines(inputs.feed_lines(spark, folder)).where("usable")
    return parsed.select(
        "row_id", "input", "output", F.get_json_object("extras", "$.accepted").alias("accepted")
    )


@query
def feed_counters(spark, folder):
    return feedback.feed_counters(inputs.feed_lines(spark, folder), consumed=100)


def _feed_folder(spark, folder) -> str:
    path = work_folder(spark, "feed")
    inputs.write_feed(spark, folder, path)
    return path


def _shard() -> F.Column:
    return F.regexp_extract("file", r"shard=(\d+)", 1).cast("bigint").alias("shard")


@query
def jsonl_from_offset(spark, folder):
    records = readers.read_jsonl_from(spark, _feed_folder(spark, folder), start_line=20)
    return records.select(_shard(), "line_no", "input", "output")


@query
def jsonl_count_and_load(spark, folder):
    total, records = readers.count_and_read_jsonl(spark, _feed_folder(spark, folder), 20)
    return records.select(
        _shard(), "line_no", "input", "output", F.lit(total).cast("bigint").alias("total")
    )


@query
def jsonl_line_totals(spark, folder):
    totals = readers.line_totals(spark, _feed_folder(spark, folder))
    return totals.select(_shard(), "lines", "filled_lines")


@query
def feed_line_kinds(spark, folder):
    return feedback.line_kinds(inputs.feed_lines(spark, folder))


_PAIR = ("row_id", "input", "output")


@query
def json_log_round_trip(spark, folder):
    """Logged pairs written as JSON and read back as training pairs."""
    path = work_folder(spark, "log")
    rows = inputs.pairs(spark, folder).select(*_PAIR)
    writers.append_log(rows.withColumn("timestamp", F.lit("2024-01-01T00:00:00")), path)
    back = writers.read_log(spark, path, "row_id BIGINT")
    return back.select("row_id", prep.training_text(F.col("input"), F.col("output")).alias("text"))


@query
def log_append_save(spark, folder):
    """A log saved twice and read, then cleared, and appended to in two parts."""
    path, kept = work_folder(spark, "log"), work_folder(spark, "saved")
    rows = feedback.stamped(inputs.pairs(spark, folder).select(*_PAIR))
    text = prep.training_text(F.col("input"), F.col("output")).alias("text")
    writers.save_log(rows, path)
    writers.save_log(rows.where("row_id % 2 = 0").drop("row_id"), path)
    writers.read_log(spark, path).where("timestamp IS NOT NULL").select(text).write.parquet(kept)
    writers.clear_log(spark, path)
    writers.append_log(rows.where("row_id % 4 = 1").drop("row_id"), path)
    writers.append_log(rows.where("row_id % 4 = 3").drop("row_id"), path)
    back = writers.read_log(spark, path).where("timestamp IS NOT NULL")
    return back.select(text).unionByName(spark.read.parquet(kept))


@query
def feedback_append(spark, folder):
    """Labelled exchanges appended to a feed and read back from it."""
    path = work_folder(spark, "feedback")
    kept = feedback.open_prompts(inputs.exchanges(spark, folder), session="conv_id")
    writers.append_feedback(feedback.label_feedback(kept), path)
    records = readers.read_jsonl(spark, path)
    accepted = F.get_json_object("extras", "$.accepted").cast("boolean")
    return records.select("input", "output", accepted.alias("accepted"))


@query
def exchanges_append(spark, folder):
    path = work_folder(spark, "exchanges")
    rows = inputs.exchanges(spark, folder).select(strip(F.col("prompt")).alias("request_json"), "response")
    rows = rows.withColumn("request_json", F.when(F.lower("request_json") == "quit", "quit").otherwise(F.col("request_json")))
    writers.append_exchanges(rows, path)
    back = spark.read.schema("stamp STRING, request_json STRING, response STRING").json(path)
    return back.select("response", "request_json", F.length("stamp").alias("stamp_chars"))


@query
def filtered_output(spark, folder):
    """The filtered dataset of the validation job, read back from its file."""
    out = work_folder(spark, "filtered")
    pairs_in = inputs.dirty_pairs(spark, folder).select(*_PAIR)
    jobs.validate(pairs_in, work_folder(spark, "scored"), filtered_path=writers.filtered_path(f"{out}.json"))
    return readers.read_json_lines(spark, writers.filtered_path(f"{out}.json"), "row_id BIGINT").select(*_PAIR)


@query
def jsonl_round_trip(spark, folder):
    path = work_folder(spark, "jsonl")
    writers.write_jsonl(inputs.pairs(spark, folder).select(*_PAIR), path)
    records = readers.read_jsonl(spark, path)
    row_id = F.get_json_object("extras", "$.row_id").cast("bigint")
    return records.select(row_id.alias("row_id"), "input", "output")


@query
def json_array_round_trip(spark, folder):
    """Pairs as one JSON array per file, read back; a long conversation fills several files."""
    path = work_folder(spark, "arrays")
    record = F.to_json(F.struct(*_PAIR))
    block = [F.floor(F.col("conv_id") / 50).alias("part"), F.floor(F.col("turn") / 256).alias("block")]
    parts = inputs.pairs(spark, folder).groupBy(*block)
    body = F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]"))
    parts.agg(body.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json(spark, path, "row_id BIGINT").select(*_PAIR)


@query
def csv_round_trip(spark, folder):
    """Texts with line breaks, quotes and commas through CSV."""
    path = work_folder(spark, "csv")
    rows = inputs.pairs(spark, folder).select(
        "row_id", F.col("input").alias("question"), F.col("output").alias("answer")
    )
    rows.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    back = readers.read_csv(spark, path)
    return back.select(F.col("row_id").cast("bigint").alias("row_id"), "input", "output")


@query
def union_pairs(spark, folder):
    """Datasets with different extra columns, appended."""
    rows = inputs.pairs(spark, folder)
    turned = rows.select("row_id", F.col("output").alias("input"), F.col("input").alias("output"), "turn")
    return readers.combine(rows.select(*_PAIR), turned)


@query
def custom_rule(spark, folder):
    rule = {"mentions the": lambda asked, said: F.contains(F.lower(said), F.lit("the"))}
    scored = quality.score_pairs(inputs.pairs(spark, folder), quality.QualityConfig(extra=rule))
    return scored.select("row_id", F.array_contains("issues", "mentions the").alias("flagged"))


@query
def planned_steps_override(spark, folder):
    return prep.planned_steps(inputs.pairs(spark, folder), batch_size=4, max_steps=77)


@query
def text_folder_stats(spark, folder):
    """Documents written as one text file each, some with names that Spark does not list, read back."""
    path = work_folder(spark, "texts")
    mark = F.element_at(F.array(F.lit("_"), F.lit(".")), (F.col("doc_id") % 50).cast("int"))
    mark = F.when((F.col("doc_id") % 50).isin(1, 2), mark).otherwise("")
    documents = spread(inputs.table(spark, folder, "documents").select("doc_id", "text"))
    files = documents.select(
        F.floor(F.col("doc_id") / 1000).cast("string").alias("folder"),
        F.concat(mark, F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    inputs.write_text_files(files, path)
    back = readers.read_text_folder(spark, f"{path}/*")
    doc_id = F.regexp_extract("name", r"(\d+)\.txt", 1).cast("bigint")
    return back.select(
        doc_id.alias("doc_id"), F.length("content").alias("chars"), F.md5(F.encode("content", "utf-8")).alias("digest")
    )


@query
def path_rank(spark, folder):
    """Documents' place in the order of their file names, a text key."""
    documents = inputs.table(spark, folder, "documents").select("doc_id", "source", "lang")
    name = F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string"))
    return numbering.with_rank(documents.select("doc_id", name.alias("name")), "name")


@query
def stamp_text(spark, folder):
    """Stamps of fixed moments, as exchanges carry them."""
    events = inputs.table(spark, folder, "events").select("event_id", "ts")
    return events.select("event_id", feedback.compact_stamp(F.col("ts")).alias("stamp"))


@query
def json_array_one_file(spark, folder):
    """All pairs in one file holding an array, in row order, cut again by many tasks."""
    path = f"{work_folder(spark, 'array')}/pairs.json"
    writers.write_json_array(inputs.pairs(spark, folder).select(*_PAIR), path, "row_id")
    ranked = numbering.with_rank(framing.json_objects(spark, path), "split", "no")
    record = F.from_json("text", "row_id BIGINT, input STRING, output STRING", {"mode": "FAILFAST"})
    return ranked.select("position", record.alias("r")).select("position", "r.*")


@query
def csv_cells(spark, folder):
    """Documents in CSV: long cells with line breaks, cut by many tasks."""
    path = work_folder(spark, "csv")
    texts = inputs.table(spark, folder, "documents").select("doc_id", F.col("text").alias("question"), F.col("lang").alias("answer"))
    texts.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    back = readers.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.encode("input", "utf-8")).alias("digest"), "output")


@query
def stream_feedback_cycle(spark, folder):
    """The whole feed through the stream, a few files at a time; all published texts."""
    feed = _feed_folder(spark, folder)
    stream = FeedbackStream(spark, feed, work_folder(spark, "cycles"), threshold=50)
    stream.start(once=True, files_per_batch=max(1, len(Store(spark, feed).names()) // 4)).awaitTermination()
    stream.finish()
    if stream.snapshots.current() is None:
        return spark.createDataFrame([], "text STRING")
    return stream.snapshots.read_all().select("text")


def _published(spark, stream: FeedbackStream):
    if stream.snapshots.current() is None:
        return spark.createDataFrame([], "text STRING")
    return stream.snapshots.read_all().select("text")


@query
def stream_growing_feed(spark, folder):
    """The feed in files that grow between batches, their last lines unfinished at first."""
    feed = work_folder(spark, "growing")
    stream = FeedbackStream(spark, feed, work_folder(spark, "cycles"), threshold=50, growing=True)
    for rounds in (1, 2, 3):
        inputs.write_growing_feed(spark, folder, feed, rounds)
        stream.start(once=True).awaitTermination()
    stream.finish()
    return _published(spark, stream)


@query
def stream_replayed_batch(spark, folder):
    """The feed through a stream that fails between publishing and saving its state, and goes on."""
    stream = FailsOnce(spark, _feed_folder(spark, folder), work_folder(spark, "cycles"), threshold=50)
    while True:
        try:
            stream.start(once=True).awaitTermination()
            break
        except StreamingQueryException as failure:
            if "drill" not in str(failure):
                raise
    stream.finish()
    return _published(spark, stream)


@query
def log_flushes(spark, folder):
    """Exchanges of ten conversations a session, flushed every ten rows; the rest when told."""
    source = work_folder(spark, "exchanges")
    stream = CountedLogStream(spark, source, work_folder(spark, "flushes"), flush_rows=10)
    session = F.floor(F.col("conv_id") / 10)
    rows = inputs.pairs(spark, folder).select(
        session.cast("string").alias("session"), F.col("input").alias("prompt"), F.col("output").alias("response")
    )
    rows.write.mode("append").json(source)
    stream.start(once=True).awaitTermination()
    control = F.when(F.col("session").cast("bigint") % 2 == 0, "STOP").otherwise("FLUSH")
    rows.select("session").distinct().withColumn("control", control).write.mode("append").json(source)
    stream.start(once=True).awaitTermination()
    return stream.log().groupBy("session", "flush_no", "cause").agg(F.count("*").alias("rows"))


@query
def feedback_by_hour(spark, folder):
    """Accepted and corrected answers per hour of event time, and what came too late.

    Four rounds of conversations arrive one after the other, each in any order; then time moves
    on by a day, and the answers of some conversations come after that.
    """
    seconds = F.lit(1704067200) + F.col("conv_id") * 600 + F.col("turn")
    rows = feedback.label_feedback(inputs.exchanges(spark, folder)).select(
        "conv_id", F.timestamp_seconds(seconds).alias("at"), "accepted"
    )
    last, latest = rows.agg(F.max("conv_id"), F.max("at")).first()
    if last is None:
        return spark.createDataFrame([], "hour BIGINT, accepted BIGINT, corrected BIGINT, late_accepted BIGINT, late_corrected BIGINT")
    late = F.col("conv_id") % 13 == 5
    turn = F.when(late, 5).otherwise(F.floor(F.col("conv_id") * 4 / (last + 1)))
    beat = spark.range(1).select(
        (F.lit(latest) + F.expr("INTERVAL 1 DAY")).alias("at"), F.lit(None).cast("boolean").alias("accepted")
    )
    feed, closed = work_folder(spark, "feedback"), work_folder(spark, "windows")
    state = work_folder(spark, "state")
    for number in range(6):
        arrived = beat if number == 4 else rows.where(turn == number).select("at", "accepted")
        arrived.write.mode("append").parquet(feed)
        windows = feedback_windows(spark.readStream.schema("at TIMESTAMP, accepted BOOLEAN").parquet(feed))
        writer = windows.writeStream.format("parquet").option("path", closed).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
    given = spark.read.schema("start TIMESTAMP, end TIMESTAMP, accepted BIGINT, corrected BIGINT").parquet(closed)
    missed = late_counts(spark.read.parquet(feed), given).withColumnRenamed("start", "missed")
    both = given.join(missed, F.col("start") == F.col("missed"), "full")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("accepted", "corrected", "late_accepted", "late_corrected")]
    hour = F.unix_timestamp(F.coalesce("start", "missed")).alias("hour")
    return both.select(hour, *counts).where("accepted + corrected + late_accepted + late_corrected > 0")
