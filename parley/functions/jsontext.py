"""JSON read from loose text: small per-row helpers behind Arrow UDFs.

Spark's own parsers accept what a strict reader must reject (text after the
object, single quotes) and reject what the repair must accept (dict literals,
trailing commas), so these two readers run in Python, batch by batch.
"""

from __future__ import annotations

import ast
import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

_BRACE = re.compile(r"[{}]")
_TRAILING_COMMA = re.compile(r",\s*([}\]])")
# Half of an emoji escape: no text, so it becomes the replacement character.
_HALF_PAIR = re.compile("[\ud800-\udfff]")

RECORD = StructType(
    [
        StructField("usable", BooleanType()),
        StructField("kind", StringType()),
        StructField("input", StringType()),
        StructField("output", StringType()),
        StructField("extras", StringType()),
    ]
)
EXTRACTED = StructType(
    [StructField("request_json", StringType()), StructField("parse_error", StringType())]
)


def _plain(value):
    """Make a parsed value portable JSON: no NaN, only text keys, no half pairs."""
    if isinstance(value, dict):
        return {_whole(str(key)): _plain(item) for key, item in value.items()}
    if isinstance(value, str):
        return _whole(value)
    if isinstance(value, list):
        return [_plain(item) for item in value]
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if value is None or isinstance(value, (int, float)):
        return value
    return _whole(str(value))


def _whole(text: str) -> str:
    return _HALF_PAIR.sub("\ufffd", text)


def _dump(value) -> str:
    return json.dumps(_plain(value), ensure_ascii=False)


def _as_text(value) -> str | None:
    if isinstance(value, str):
        return _whole(value)
    return None if value is None else _dump(value)


def read_record(line: str | None) -> tuple[bool, str, str | None, str | None, str | None]:
    """One feed line: (usable, kind, input, output, other fields as JSON).

    Kinds: usable, malformed, keyless (no object with both keys) and, for null, which
    stands for bytes that are no UTF-8, undecodable.
    """
    if line is None:
        return False, "undecodable", None, None, None
    try:
        record = json.loads(line.strip())
    except (ValueError, RecursionError):
        return False, "malformed", None, None, None
    if not isinstance(record, dict) or not {"input", "output"} <= record.keys():
        return False, "keyless", None, None, None
    asked, said = _as_text(record.pop("input")), _as_text(record.pop("output"))
    return True, "usable", asked, said, _dump(record) if record else None


def first_object(text: str) -> str:
    """The first brace-balanced stretch; braces inside quotes count too."""
    start = text.find("{")
    if start < 0:
        raise ValueError("No JSON object found in LLM output")
    open_braces = 0
    for brace in _BRACE.finditer(text, start):
        open_braces += 1 if brace.group() == "{" else -1
        if not open_braces:
            return text[start : brace.end()]
    raise ValueError("Unbalanced braces — JSON object not closed")


def _literal(text: str) -> dict:
    value = ast.literal_eval(text)
    if not isinstance(value, dict):
        raise ValueError("not a dict")
    return value


# Readers in order of preference.
_READERS = (json.loads, _literal, lambda text: json.loads(_TRAILING_COMMA.sub(r"\1", text)))


def read_object(text: str | None) -> tuple[str | None, str | None]:
    """(canonical JSON, None) of the object in free text, or (None, error)."""
    try:
        candidate = first_object(text or "")
    except ValueError as problem:
        return None, _whole(str(problem))
    message = ""
    for reader in _READERS:
        try:
            return _dump(reader(candidate)), None
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError) as problem:
            message = _whole(f"JSON parse error: {problem}")
    return None, message


@F.pandas_udf(RECORD)
def _records(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_record(line) for line in lines], columns=RECORD.names)


@F.pandas_udf(EXTRACTED)
def _objects(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_object(text) for text in texts], columns=EXTRACTED.names)


def parse_record(line: Column) -> Column:
    """Bytes that are no UTF-8 cannot enter Python: such a line arrives there as null."""
    return _records(F.when(F.is_valid_utf8(line), line))


def extract_json(text: Column) -> Column:
    """As above: text that is no UTF-8 holds no object."""
    return _objects(F.when(F.is_valid_utf8(text), text))
