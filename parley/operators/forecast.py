"""Forecast requests: reading, validating, repairing, and rendering results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed_values as fixed
from parley.functions.jsontext import extract_json
from parley.session import computed_once
from parley.functions.text import float_or_null, float_text, right_align, strip, two_decimals

REQUEST_FIELDS = ("query", "duration", "interval", "format", "targets", "data", "data_dir")
_NO_TARGETS = "array<string>"


def _quoted_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{name}'" for name in sorted(names)) + "]"


def validate_requests(df: DataFrame, json_col: str = "request_json") -> DataFrame:
    """Add the typed request fields and ``error`` (null when valid).

    Works on any JSON value types: fields are read from a VARIANT, so a numeric
    string and a number are told apart from a wrong type.  The first failing
    check names the error.
    """
    fields = ("query", "duration", "interval", "format", "targets", "data", "data_dir")
    # Parsed once, then each field picked once: later columns only look at those.
    parsed = df.withColumn("_request", F.try_parse_json(json_col))
    picked = parsed.withColumns(
        {f"_{name}": F.try_variant_get("_request", f"$.{name}", "variant") for name in fields}
    )
    typed = picked.withColumns(
        {
            f"_{name}_kind": F.coalesce(F.schema_of_variant(f"_{name}"), F.lit("MISSING"))
            for name in ("query", "duration", "interval", "format", "targets")
        }
    ).withColumns({f"_{name}_text": F.try_variant_get(f"_{name}", "$", "string") for name in fields})

    def number(name: str) -> Column:
        kind, text = F.col(f"_{name}_kind"), F.col(f"_{name}_text")
        return (
            F.when(kind == "STRING", float_or_null(text))
            .when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
            .otherwise(F.try_variant_get(f"_{name}", "$", "double"))
        )

    query_kind = F.col("_query_kind")
    read = typed.withColumns(
        {
            "_is_object": F.coalesce(
                F.schema_of_variant("_request").startswith("OBJECT"), F.lit(False)
            ),
            "query": F.when(query_kind == "MISSING", fixed.DEFAULT_QUERY).when(
                query_kind == "STRING", strip(F.col("_query_text"))
            ),
            "duration": number("duration"),
            "interval": number("interval"),
            "format": F.col("_format_text"),
            "targets": F.transform(
                F.try_variant_get("_targets", "$", "array<string>"),
                lambda name: F.coalesce(name, F.lit("None")),
            ),
            "data": F.col("_data_text"),
            "data_dir": F.col("_data_dir_text"),
        }
    )
    return _checked(read, df.columns)


def _checked(read: DataFrame, kept: list[str]) -> DataFrame:
    valid_targets = F.array(*[F.lit(name) for name in fixed.TARGETS])

    def positive(name: str) -> list[tuple[Column, Column]]:
        value = F.col(name)
        return [
            (value.isNull(), F.lit(f"'{name}' must be a number")),
            (value <= 0, F.lit(f"'{name}' must be a positive number")),
        ]

    targets_kind = F.col("_targets_kind")
    # Empty text, zero, false and empty containers all mean "no targets given".
    absent = (
        targets_kind.isin("MISSING", "VOID", "ARRAY<VOID>", "OBJECT<>")
        & ~(F.coalesce(F.size("targets"), F.lit(0)) > 0)
    ) | F.coalesce(
        ~targets_kind.startswith("ARRAY")
        & (
            F.col("_targets_text").isin("", "false")
            | ((targets_kind != "STRING") & (F.col("_targets_text").try_cast("double") == 0))
        ),
        F.lit(False),
    )
    unknown = F.array_sort(F.array_distinct(F.array_except("targets", valid_targets)))
    checks = [(~F.col("_is_object"), F.lit("Request is not a JSON object"))]
    checks += [
        (F.col(f"_{name}_kind") == "MISSING", F.lit(f"Missing required field: '{name}'"))
        for name in ("duration", "interval", "format")
    ]
    checks.append(
        (F.coalesce(F.col("query") == "", F.lit(True)), F.lit("'query' must be a non-empty string"))
    )
    checks += positive("duration") + positive("interval")
    checks += [
        (
            ~((F.col("_format_kind") == "STRING") & F.col("format").isin(fixed.FORMATS)),
            F.concat(
                F.lit(f"'format' must be one of {_quoted_list(fixed.FORMATS)}, got '"),
                F.coalesce("format", F.lit("None")),
                F.lit("'"),
            ),
        ),
        (~absent & ~targets_kind.startswith("ARRAY"), F.lit("'targets' must be a list")),
        (
            ~absent & (F.size(unknown) > 0),
            F.concat(
                F.lit("Invalid target(s): ['"),
                F.array_join(unknown, "', '"),
                F.lit(f"']. Must be from {_quoted_list(fixed.TARGETS)}"),
            ),
        ),
    ]
    error = F.lit(None).cast("string")
    for failed, message in reversed(checks):
        error = F.when(failed, message).otherwise(error)
    no_targets = F.array().cast(_NO_TARGETS)
    return read.withColumn("error", error).select(
        *kept,
        *[
            F.when(absent, no_targets).otherwise(F.col(name)).alias(name)
            if name == "targets"
            else F.col(name)
            for name in REQUEST_FIELDS
        ],
        "error",
    )


def split_requests(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, quarantined rows with their error)."""
    failed = F.col("error").isNotNull()
    return validated.where(~failed).drop("error"), validated.where(failed)


def heuristic_request(text: Column) -> dict[str, Column]:
    """Best-effort request fields from a user's own words."""
    lowered = F.lower(text)
    pattern = "(?U)" + fixed.DURATION_PATTERN
    amount = F.regexp_extract(lowered, pattern, 1).try_cast("double")
    unit = F.regexp_extract(lowered, pattern, 2)
    hours = (
        F.when(unit.startswith("day"), amount * 24.0)
        .when(unit.startswith("min"), amount / 60.0)
        .otherwise(amount)
    )

    def mentions(words: list[str]) -> Column:
        return lowered.rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")

    targets = F.array_compact(
        F.array(*[F.when(mentions(words), name) for name, words in fixed.TARGET_KEYWORDS.items()])
    )
    chosen = F.lit(fixed.DEFAULT_FORMAT)
    for name in reversed(fixed.FORMATS):
        chosen = F.when(mentions([name]), name).otherwise(chosen)
    return {
        "query": F.lit(fixed.DEFAULT_QUERY),
        "duration": F.coalesce(hours, F.lit(fixed.DEFAULT_DURATION)),
        "interval": F.lit(fixed.DEFAULT_INTERVAL),
        "format": chosen,
        "targets": targets,
    }


def resolve_requests(
    df: DataFrame, user_col: str = "user_request", model_col: str = "model_output"
) -> DataFrame:
    """The model's request where it is valid, else the heuristic one.

    ``request_source`` tells which; ``model_error`` keeps why the model's failed.
    The heuristic fields always hold a positive interval, a known format and
    known targets; only a zero duration in the text can fail the second check.
    """
    extracted = computed_once(df, "_extracted", extract_json(F.col(model_col))).select(
        *df.columns, "_extracted.request_json", "_extracted.parse_error"
    )
    checked = validate_requests(extracted).withColumn(
        "model_error", F.coalesce("parse_error", "error")
    )
    guess = heuristic_request(F.col(user_col))
    failed = F.col("model_error").isNotNull()
    fields = {
        name: F.when(failed, guess.get(name, F.lit(None))).otherwise(F.col(name))
        for name in REQUEST_FIELDS
    }
    resolved = checked.select(
        *df.columns,
        *[column.alias(name) for name, column in fields.items()],
        F.when(failed, "heuristic").otherwise("model").alias("request_source"),
        "model_error",
    )
    bad = F.col("duration") <= 0
    return resolved.withColumn("error", F.when(bad, "'duration' must be a positive number"))


def parse_query(df: DataFrame, query_col: str = "query") -> DataFrame:
    """Add ``query_map`` (key to text and number) and ``query_error``.

    A repeated key keeps its last value.  Any pair without ``=`` makes the whole
    query an error.
    """
    pairs = F.split(query_col, ",")
    bad = F.get(F.filter(pairs, lambda pair: ~F.contains(pair, F.lit("="))), F.lit(0))

    def entry(pair: Column) -> Column:
        parts = F.split(pair, "=", 2)
        value = strip(F.get(parts, F.lit(1)))
        return F.struct(
            strip(F.get(parts, F.lit(0))).alias("key"),
            F.struct(value.alias("text"), float_or_null(value).alias("number")).alias("value"),
        )

    parsed = df.withColumn(
        "query_error",
        F.when(
            bad.isNotNull(),
            F.concat(F.lit("Invalid query pair (no '='): '"), strip(bad), F.lit("'")),
        ),
    ).withColumn("_entries", F.when(bad.isNull(), F.transform(pairs, entry)))
    keys = F.transform("_entries", lambda item: item["key"])
    last = F.filter(
        "_entries",
        lambda item, at: ~F.array_contains(
            F.slice(keys, at + 2, F.greatest(F.size(keys), F.lit(1))), item["key"]
        ),
    )
    return parsed.withColumn("query_map", F.map_from_entries(last)).drop("_entries")


def predictor_units(df: DataFrame) -> DataFrame:
    """Hours to the whole minutes and seconds a predictor takes (truncating)."""
    return df.withColumns(
        {
            "duration_minutes": (F.col("duration") * 60).cast("bigint"),
            "interval_seconds": (F.col("interval") * 3600).cast("bigint"),
        }
    )


# Grid points put into one array while expanding a request.
_GRID_BLOCK = 4096


def time_grid(df: DataFrame, start_col: str) -> DataFrame:
    """One row per expected output time, from start to start + duration.

    Expanded in three steps, so that a long and fine grid never forms one huge
    array.  A request whose interval truncates to zero seconds has no grid.
    """
    step = F.col("interval_seconds")
    last = F.floor(F.col("duration_minutes") * 60 / F.nullif(step, F.lit(0)))
    units = predictor_units(df).withColumn("_last", last).where("_last >= 0")
    wide = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / _GRID_BLOCK**2))
    start = F.col("_wide") * _GRID_BLOCK
    end = F.least(start + (_GRID_BLOCK - 1), F.floor(F.col("_last") / _GRID_BLOCK))
    blocked = (
        units.withColumn("_wide", F.explode(wide))
        .withColumn("_block", F.explode(F.sequence(start, end)))
        .drop("_wide")
    )
    first = F.col("_block") * _GRID_BLOCK
    inside = F.sequence(first, F.least(first + (_GRID_BLOCK - 1), F.col("_last")))
    return (
        blocked.withColumn("step", F.explode(inside))
        .withColumn(
            "predicted_at",
            F.timestamp_add("SECOND", F.col("step") * step, F.col(start_col)),
        )
        .drop("_last", "_block")
    )


def target_columns(targets: list[str] | None) -> list[str]:
    return ["datetime", *(targets or fixed.TARGETS)]


def prediction_csv(targets: list[str] | None = None) -> tuple[str, Column]:
    """(header line, line per prediction row); missing values are empty."""
    names = target_columns(targets)
    cells = [
        F.coalesce(F.col(name) if name == "datetime" else float_text(F.col(name)), F.lit(""))
        for name in names
    ]
    return ",".join(names), F.concat_ws(",", *cells)


def prediction_table(targets: list[str] | None = None) -> tuple[str, str, Column]:
    """(header line, rule, line per prediction row), 12 characters per column."""
    names = target_columns(targets)
    header = "  ".join(f"{name:>12}" for name in names)
    cells = [
        right_align(
            F.coalesce(
                F.col(name) if name == "datetime" else two_decimals(F.col(name)), F.lit("")
            ),
            12,
        )
        for name in names
    ]
    return header, "-" * len(header), F.concat_ws("  ", *cells)


def prediction_json(df: DataFrame) -> Column:
    """A prediction row as one JSON object: all columns, plain numbers, null where missing."""
    pairs = []
    for name, kind in df.dtypes:
        value = F.col(name)
        if kind in ("double", "float"):
            text = float_text(value.cast("double"))
        elif kind == "string":
            # One-element array: the quoted text without its brackets.
            text = F.expr(f"substring(to_json(array(`{name}`)), 2, length(to_json(array(`{name}`))) - 2)")
            text = F.when(value.isNotNull(), text)
        else:
            text = value.cast("string")
        key = F.lit(json.dumps(name, ensure_ascii=False) + ": ")
        pairs.append(F.concat(key, F.coalesce(text, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def format_predictions(
    df: DataFrame, fmt: str = "table", targets: list[str] | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """Rendered lines as rows: ``by`` columns, ``line_kind``, ``datetime``, ``line``.

    Rows stay distributed; sorting by (by, line_kind, datetime) gives the text.
    ``line_kind`` is 0 header, 1 rule, 2 data.  No rows in, no rows out.
    """
    if fmt == "json":
        plain = df.drop(*by)
        lines = [(2, prediction_json(plain))]
        front = []
    elif fmt == "csv":
        header, line = prediction_csv(targets)
        front, lines = [(0, header)], [(2, line)]
    else:
        header, rule, line = prediction_table(targets)
        front, lines = [(0, header), (1, rule)], [(2, line)]
    body = df.select(
        *by, F.lit(lines[0][0]).alias("line_kind"), "datetime", lines[0][1].alias("line")
    )
    # Header lines appear where there is at least one row.
    groups = df.select(*by).distinct() if by else df.select(F.lit(1)).limit(1)
    for kind, text in front:
        top = groups.select(
            *by,
            F.lit(kind).alias("line_kind"),
            F.lit(None).cast("string").alias("datetime"),
            F.lit(text).alias("line"),
        )
        body = body.unionByName(top)
    return body


def forecast_reports(
    predictions: DataFrame, by: list[str], request: Column, instructions: str, targets: list[str] | None = None
) -> DataFrame:
    """One report prompt per request: all its prediction rows as CSV, in time order.

    ``by`` names the request; a request's rows meet in one prompt, which a model must
    be able to read, so they are few.
    """
    header, line = prediction_csv(targets)
    rows = F.array_sort(F.collect_list(F.struct("datetime", line.alias("line"))))
    grouped = predictions.groupBy(*by).agg(rows.alias("rows"))
    lines = F.concat(F.array(F.lit(header)), F.transform("rows", lambda row: row["line"]))
    data = F.array_join(lines, "\n")
    return grouped.select(*by, report_prompt(instructions, request, data).alias("prompt"))


def report_prompt(instructions: str, request: Column, predicted: Column) -> Column:
    """The prompt asking a model to put predictor output into words."""
    return F.concat(
        F.lit(f"{instructions}\n\nOriginal request: "),
        request,
        F.lit("\n\nForecast data:\n"),
        predicted,
        F.lit("\n\nReport:"),
    )


def request_prompt(instructions: str, request: Column) -> Column:
    """The prompt asking a model for a structured request."""
    return F.concat(F.lit(f"{instructions}\n\nRequest: "), request)
