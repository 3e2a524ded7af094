import json

import pytest
from pyspark.sql import functions as F

from parley import fixed_values as fixed
from parley.functions.jsontext import extract_json, read_object
from parley.operators import forecast

BASE = {"query": "sensor_id=1", "duration": 24, "interval": 1, "format": "json"}


def without(name):
    return {key: value for key, value in BASE.items() if key != name}


def check(spark, request):
    text = request if isinstance(request, str) else json.dumps(request)
    frame = spark.createDataFrame([(text,)], "request_json string")
    return forecast.validate_requests(frame).first()


@pytest.mark.parametrize(
    "text,found",
    [
        ('{"a": 1}', {"a": 1}),
        ('Sure: {"a": {"b": [1, 2]}} and {"c": 3}', {"a": {"b": [1, 2]}}),
        ("x {'a': 'b', 'n': None, 't': True, 'l': ['p', 'q'],} y", {"a": "b", "n": None, "t": True, "l": ["p", "q"]}),
        ('{"a": true, "b": [1,2, ],\n}', {"a": True, "b": [1, 2]}),
        ('{"dup": 1, "dup": 2}', {"dup": 2}),
        ('{"v": NaN}', {"v": "nan"}),
    ],
)
def test_objects_are_found_and_repaired(spark, text, found):
    frame = spark.createDataFrame([(text,)], "t string")
    row = frame.select(extract_json(F.col("t")).alias("r")).first().r
    assert json.loads(row.request_json) == found and row.parse_error is None


@pytest.mark.parametrize(
    "text,error",
    [
        ("no braces", "No JSON object found"),
        (None, "No JSON object found"),
        ('{"a": 1', "Unbalanced braces"),
        ('{"a": "}"}', "JSON parse error"),  # quotes do not protect braces
        ("{bad json: }", "JSON parse error"),
        ("{1, 2}", "JSON parse error"),  # a set is not an object
    ],
)
def test_unreadable_outputs(text, error):
    found, problem = read_object(text)
    assert found is None and problem.startswith(error)


def test_valid_requests(spark):
    row = check(spark, {**BASE, "query": "  a=1 ", "targets": ["temp", "temp"], "data": "/d", "data_dir": None})
    assert row.error is None
    assert (row.query, row.duration, row.interval, row.format) == ("a=1", 24.0, 1.0, "json")
    assert row.targets == ["temp", "temp"] and row.data == "/d" and row.data_dir is None
    assert check(spark, without("query")).query == fixed.DEFAULT_QUERY
    assert check(spark, {**BASE, "duration": " 12 "}).duration == 12.0
    assert check(spark, {**BASE, "duration": "1_0"}).duration == 10.0
    assert check(spark, {**BASE, "duration": True}).duration == 1.0
    for none in ([], None, "", 0, 0.0, False, {}):
        row = check(spark, {**BASE, "targets": none})
        assert row.error is None and row.targets == [], none


@pytest.mark.parametrize(
    "request_,error",
    [
        (without("duration"), "Missing required field: 'duration'"),
        (without("interval"), "Missing required field: 'interval'"),
        (without("format"), "Missing required field: 'format'"),
        ({**BASE, "query": "  "}, "'query' must be a non-empty string"),
        ({**BASE, "query": None}, "'query' must be a non-empty string"),
        ({**BASE, "query": 5}, "'query' must be a non-empty string"),
        ({**BASE, "duration": "long"}, "'duration' must be a number"),
        ({**BASE, "duration": "1d"}, "'duration' must be a number"),
        ({**BASE, "duration": None}, "'duration' must be a number"),
        ({**BASE, "duration": [1]}, "'duration' must be a number"),
        ({**BASE, "duration": 0}, "'duration' must be a positive number"),
        ({**BASE, "duration": -1, "interval": 0}, "'duration' must be a positive number"),
        ({**BASE, "interval": False}, "'interval' must be a positive number"),
        ({**BASE, "interval": -0.5}, "'interval' must be a positive number"),
        ({**BASE, "format": "xml"}, "'format' must be one of ['csv', 'json', 'table'], got 'xml'"),
        ({**BASE, "format": None}, "'format' must be one of ['csv', 'json', 'table'], got 'None'"),
        ({**BASE, "targets": "temp"}, "'targets' must be a list"),
        ({**BASE, "targets": 3}, "'targets' must be a list"),
        ({**BASE, "targets": {"temp": 1}}, "'targets' must be a list"),
        ({**BASE, "targets": ["wind", "temp", "rain", "wind"]},
         "Invalid target(s): ['rain', 'wind']. Must be from ['barometer', 'humidity', 'light', 'temp']"),
        ({**BASE, "targets": [None]},
         "Invalid target(s): ['None']. Must be from ['barometer', 'humidity', 'light', 'temp']"),
        ("[1]", "Request is not a JSON object"),
        ("nope", "Request is not a JSON object"),
    ],
)
def test_invalid_requests(spark, request_, error):
    assert check(spark, request_).error == error


@pytest.mark.parametrize(
    "text,duration,targets,fmt",
    [
        ("what is the forecast for the next 6 hours?", 6.0, [], "table"),
        ("Top 5 TEMPERATURE gradients over 12 hrs as JSON", 12.0, ["temp"], "json"),
        ("predict pressure and humid air for 30 minutes", 0.5, ["barometer", "humidity"], "table"),
        ("3-day solar forecast, csv or json", 72.0, ["light"], "json"),
        ("60 mins of light", 1.0, ["light"], "table"),
        ("2.5 hours", 2.5, [], "table"),
        ("1 day", 24.0, [], "table"),
        ("6-hr", 6.0, [], "table"),
        ("notable jsonify daylight temps", 24.0, [], "table"),
        ("5 hourly readings then 7 days", 168.0, [], "table"),
    ],
)
def test_heuristics(spark, text, duration, targets, fmt):
    frame = spark.createDataFrame([(text,)], "t string")
    fields = forecast.heuristic_request(F.col("t"))
    row = frame.select(*[column.alias(name) for name, column in fields.items()]).first()
    assert (row.duration, row.targets, row.format) == (duration, targets, fmt)
    assert (row["query"], row.interval) == ("sensor_id=1", 1.0)


def test_model_first_then_heuristic(spark):
    rows = [
        ("humidity for 3 hours", json.dumps({**BASE, "duration": 5})),
        ("humidity for 3 hours", "no idea"),
        ("humidity for 3 hours", '{"query": "sensor_id=9"}'),
        ("humidity for 0 hours", "no idea"),
    ]
    frame = spark.createDataFrame(rows, "user_request string, model_output string")
    got = forecast.resolve_requests(frame).collect()
    assert [r.request_source for r in got] == ["model", "heuristic", "heuristic", "heuristic"]
    assert [r.duration for r in got] == [5.0, 3.0, 3.0, 0.0]
    assert got[1].targets == ["humidity"] and got[2]["query"] == "sensor_id=1"
    assert got[2].model_error == "Missing required field: 'duration'"
    valid, failed = forecast.split_requests(forecast.resolve_requests(frame))
    assert valid.count() == 3 and failed.first().error == "'duration' must be a positive number"


@pytest.mark.parametrize(
    "text,found,error",
    [
        ("sensor_id=1,latitude=40.0,longitude=-105.5", {"sensor_id": 1.0, "latitude": 40.0, "longitude": -105.5}, None),
        ("sensor_id=ABC , note=a=b", {"sensor_id": "ABC", "note": "a=b"}, None),
        ("a=1,a=x,a=2", {"a": 2.0}, None),
        ("a=1,b=2,a=3", {"a": 3.0, "b": 2.0}, None),
        ("a=", {"a": ""}, None),
        ("a=1d,b=1_000", {"a": "1d", "b": 1000.0}, None),
        ("a=1, bad ,c", None, "Invalid query pair (no '='): 'bad'"),
        ("", None, "Invalid query pair (no '='): ''"),
    ],
)
def test_query_strings(spark, text, found, error):
    frame = spark.createDataFrame([(text,)], "query string")
    row = forecast.parse_query(frame).first()
    got = row.query_map and {
        key: value.number if value.number is not None else value.text for key, value in row.query_map.items()
    }
    assert got == found and row.query_error == error


def test_units_and_grid(spark):
    frame = spark.sql("SELECT timestamp'2024-06-01 00:00:00' AS start, 2.0D AS duration, 0.5D AS interval")
    row = forecast.predictor_units(frame).first()
    assert (row.duration_minutes, row.interval_seconds) == (120, 1800)
    times = [str(r.predicted_at) for r in forecast.time_grid(frame, "start").orderBy("step").collect()]
    assert times[0] == "2024-06-01 00:00:00" and times[-1] == "2024-06-01 02:00:00" and len(times) == 5


def test_grid_is_blocked_and_zero_interval_has_none(spark):
    frame = spark.sql(
        "SELECT timestamp'2024-06-01 00:00:00' AS start, duration, interval FROM VALUES "
        "(10.0D, CAST(1 AS DOUBLE) / 3600), (5.0D, 0.0D) AS t(duration, interval)"
    )
    grid = forecast.time_grid(frame, "start")
    assert grid.count() == 36001
    assert grid.selectExpr("count(DISTINCT step) AS n", "max(step) AS m").first()[:] == (36001, 36000)


PREDICTIONS = [
    (1, 1000, "2024-01-01T10:00:00", 20.5, None, None, 55.0),
    (1, 2800, "2024-01-01T10:30:00", -21.0, 1013.255, 300.0, None),
]
SCHEMA = "sensor_id int, timestamp bigint, datetime string, temp double, barometer double, light double, humidity double"


def rendered(frame, *arguments):
    lines = forecast.format_predictions(frame, *arguments).orderBy("line_kind", "datetime")
    return "\n".join(r.line for r in lines.collect())


def test_predictions_render(spark):
    frame = spark.createDataFrame(PREDICTIONS, SCHEMA)
    assert rendered(frame, "csv", ["temp"]) == (
        "datetime,temp\n2024-01-01T10:00:00,20.5\n2024-01-01T10:30:00,-21.0"
    )
    assert rendered(frame, "csv").split("\n")[1] == "2024-01-01T10:00:00,20.5,,,55.0"
    names = ["datetime", *fixed.TARGETS]
    header = "  ".join(f"{name:>12}" for name in names)
    assert rendered(frame, "table").split("\n") == [
        header,
        "-" * len(header),
        f"2024-01-01T10:00:00  {20.5:>12.2f}  {'':>12}  {'':>12}  {55.0:>12.2f}",
        f"2024-01-01T10:30:00  {-21.0:>12.2f}  {1013.255:>12.2f}  {300.0:>12.2f}  {'':>12}",
    ]
    objects = [json.loads(line) for line in rendered(frame, "json").split("\n")]
    assert objects[0] == {
        "sensor_id": 1, "timestamp": 1000, "datetime": "2024-01-01T10:00:00", "temp": 20.5, "barometer": None,
        "light": None, "humidity": 55.0,
    }


def test_no_predictions_no_lines(spark):
    frame = spark.createDataFrame([], SCHEMA)
    for fmt in fixed.FORMATS:
        assert rendered(frame, fmt) == ""


def test_prompts(spark):
    frame = spark.createDataFrame([("r", "d")], "r string, d string")
    row = frame.select(
        forecast.report_prompt("Say it.", F.col("r"), F.col("d")), forecast.request_prompt("JSON only.", F.col("r"))
    ).first()
    assert row[0] == "Say it.\n\nOriginal request: r\n\nForecast data:\nd\n\nReport:"
    assert row[1] == "JSON only.\n\nRequest: r"
