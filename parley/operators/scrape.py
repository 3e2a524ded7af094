"""Scraped text to (input, output) pairs.

Input rows are ``name`` (file name with extension) and ``content`` (text with
``\\n`` line ends).  Every step is a native column; the chain is one narrow
projection with no shuffle.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import fixed_values as fixed
from parley.functions.text import capitalise, head, strip, word_count

_WS = fixed.WHITESPACE_CLASS
PLACEHOLDERS = ("topic", "source", "content_type", "category", "filename")


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def topic_from_filename(name: Column) -> Column:
    spaced = F.translate(stem(name), "_-", "  ")
    bare = F.regexp_replace(F.regexp_replace(spaced, "https?://", ""), r"www\.", "")
    return capitalise(strip(F.regexp_replace(bare, _WS + "+", " ")))


def topic_from_content(content: Column) -> Column:
    """First title-like line of the first ten, else the first longer line, cut."""
    text = strip(content)
    # Ten lines plus the unsplit rest: long documents are not split whole.
    first_lines = F.transform(F.slice(F.split(text, "\n", 11), 1, 10), strip)

    def title_like(line: Column) -> Column:
        return (
            (line != "")
            & ~line.startswith("#")
            & (F.length(line) < 100)
            & (word_count(line, 15) < 15)
        )

    title = F.get(F.filter(first_lines, title_like), F.lit(0))
    all_lines = F.transform(F.split(text, "\n"), strip)
    line = F.get(F.filter(all_lines, lambda item: F.length(item) > 10), F.lit(0))
    shortened = F.when(F.length(line) > 100, F.concat(head(line, 100), F.lit("..."))).otherwise(line)
    return F.coalesce(title, shortened, F.lit(fixed.NO_TOPIC))


def choose_topic(content_topic: Column, name: Column) -> Column:
    weak = (content_topic == fixed.NO_TOPIC) | (F.length(content_topic) < 5)
    return F.when(weak, topic_from_filename(name)).otherwise(content_topic)


def source_of(name: Column) -> Column:
    """Site name read out of an URL-like file name."""
    base = stem(name)

    def first(text: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    after_scheme = first(F.lower(base), r"https?[_\-](?:www[_\-.])?([a-zA-Z0-9]+)")
    dotted = first(base, r"(?U)\b([a-zA-Z0-9-]+)(?:[_.][a-zA-Z]+)\b")
    leading = F.get(F.split(base, r"[_\-]|" + _WS, 2), F.lit(0))

    def named(part: Column) -> Column:
        return F.when(~F.lower(part).isin(fixed.URL_WORDS), part)

    return F.coalesce(
        after_scheme, named(dotted), F.when(base != "", named(leading)), F.lit(fixed.NO_SOURCE)
    )


def content_type_of(words: Column) -> Column:
    """Label by word count (counting to 1,000 is enough)."""
    label = F.lit(None).cast("string")
    for bound, text in reversed(fixed.CONTENT_TYPES):
        label = F.lit(text) if bound is None else F.when(words < bound, text).otherwise(label)
    return label


def category_of(lowered: Column) -> Column:
    category = F.lit(fixed.NO_CATEGORY)
    for name, keywords in reversed(fixed.CATEGORIES):
        found = [F.contains(lowered, F.lit(word)) for word in keywords]
        category = F.when(reduce(or_, found), name).otherwise(category)
    return category


def clean_content(content: Column, remove_first_line: bool = False) -> Column:
    text = content
    if remove_first_line:
        title = strip(F.get(F.split(content, "\n", 2), F.lit(0)))
        rest = F.get(F.split(content, "\n", 2), F.lit(1))
        droppable = rest.isNotNull() & (F.length(title) < 150) & ~title.endswith(".")
        text = F.when(droppable, rest).otherwise(content)
    text = F.regexp_replace(text, rf"\n{_WS}*\n{_WS}*\n+", "\n\n")
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, "(?diu)Cookie Policy.*?Accept", "")
    text = F.regexp_replace(text, "(?iu)Subscribe to newsletter", "")
    return strip(text)


def choose_template(
    key: Column, template: str | None = None, randomize: bool = True, seed: str = ""
) -> Column:
    """Position of the built-in template for a row, or null for a given template.

    The choice hangs on the key's digest: varied across rows, the same on a rerun.
    """
    if template:
        return F.lit(None).cast("int")
    if not randomize:
        return F.lit(0)
    digest = F.md5(F.concat(F.lit(seed), key).cast("binary"))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return (number % len(fixed.PROMPT_TEMPLATES)).cast("int")


_SPEC = re.compile(r"(?:(.)?([<>^]))?(\d+)?(?:\.(\d+))?s?", re.DOTALL)


def _fit(value: Column, spec: str) -> Column:
    """Width, alignment and precision of a replacement field."""
    parsed = _SPEC.fullmatch(spec)
    if parsed is None:
        raise ValueError(f"Unsupported format spec {spec!r} in prompt template")
    fill, align, width, precision = parsed.groups()
    if precision is not None:
        value = head(value, int(precision))
    if not width:
        return value
    missing = F.greatest(F.lit(int(width)) - F.length(value), F.lit(0))
    left = {">": missing, "^": F.floor(missing / 2).cast("int")}.get(align or "<", F.lit(0))
    pad = F.lit(fill or " ")
    return F.concat(F.repeat(pad, left), value, F.repeat(pad, missing - left))


def fill_template(template: str) -> Column:
    """A template over the five metadata columns, parsed once when planning.

    A template with an unknown name falls back to the plain topic question for
    every row.
    """
    pieces = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is None:
            continue
        if name not in PLACEHOLDERS:
            if not name.isidentifier():
                raise ValueError(f"Unsupported placeholder {name!r} in prompt template")
            return F.concat(F.lit("Tell me about "), F.col("topic"))
        if conversion not in (None, "s"):
            raise ValueError(f"Unsupported conversion !{conversion} in prompt template")
        pieces.append(_fit(F.col(name), spec or ""))
    return F.concat(*pieces) if pieces else F.lit("")


def prompt_of(template_no: Column, template: str | None = None) -> Column:
    """Prompt text from the template position and the metadata columns."""
    if template:
        return fill_template(template)
    prompt = F.lit(None).cast("string")
    for number, text in enumerate(fixed.PROMPT_TEMPLATES):
        prompt = F.when(template_no == number, fill_template(text)).otherwise(prompt)
    return prompt


def describe(
    documents: DataFrame,
    template: str | None = None,
    randomize: bool = True,
    seed: str = "",
    min_chars: int = fixed.MIN_DOCUMENT_CHARS,
) -> DataFrame:
    """All steps: skip reason, topic, metadata, prompt and cleaned text per document."""
    content, name = F.col("content"), F.col("name")
    reason = F.when(content.isNull(), "unreadable").when(
        F.length(strip(content)) < min_chars, "too short"
    )
    return (
        documents.withColumn("skip_reason", reason)
        .withColumn("content_topic", topic_from_content(content))
        .withColumn("cleaned", clean_content(content, remove_first_line=True))
        .withColumn("topic", choose_topic(F.col("content_topic"), name))
        .withColumn("source", source_of(name))
        .withColumn("_words", word_count(F.col("cleaned"), 1000))
        .withColumn("_lowered", F.lower("cleaned"))
        .withColumn("content_type", content_type_of(F.col("_words")))
        .withColumn("category", category_of(F.col("_lowered")))
        .drop("_words", "_lowered")
        .withColumn("filename", name)
        .withColumn("template_no", choose_template(name, template, randomize, seed))
        .withColumn("prompt", prompt_of(F.col("template_no"), template))
    )


def scrape_pairs(documents: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """(input, output) pairs of the usable documents, plus any ``keep`` columns."""
    return (
        describe(documents, **options)
        .where(F.col("skip_reason").isNull())
        .select(*keep, F.col("prompt").alias("input"), F.col("cleaned").alias("output"))
    )


def scrape_counts() -> list[Column]:
    reason = F.col("skip_reason")
    return [
        F.count(F.lit(1)).alias("found"),
        F.count_if(reason.isNull()).alias("processed"),
        F.count_if(reason == "too short").alias("too_short"),
        F.count_if(reason == "unreadable").alias("unreadable"),
    ]


def scrape_stats(documents: DataFrame, min_chars: int = fixed.MIN_DOCUMENT_CHARS) -> DataFrame:
    """Documents found, processed and skipped, in one aggregation."""
    described = describe(documents, min_chars=min_chars)
    return described.select("skip_reason").agg(*scrape_counts())
