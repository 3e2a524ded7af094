"""Records of files whose separators may stand inside quotes, read by many tasks.

A split of a JSON array or a CSV file cannot tell by itself whether it starts inside a
string.  What it does to a reader's state can be told for every state it may start in,
and such functions combine: one narrow pass sums each split up, a running sum over the splits of
a file gives the state each starts in, and a second pass cuts the records exactly.  Records that
cross splits leave at most two parts per split, which are joined afterwards.

Spark's own text reader cuts and decodes the splits, so any store it reads will do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.session import work_folder

#: Split states are broadcast up to this many (some 20 MB), else joined by file and split.
BROADCAST_SPLITS = 100_000

WHOLE, TAIL, MORE, END = "whole", "tail", "more", "end"
#: White space of JSON and the byte order mark.
BLANK = " \t\r\n\ufeff"
ESCAPED = re.compile(r"\\.", re.DOTALL)

#: (fragment, inside a string at its start) -> (inside at its end, change of depth)
Step = Callable[[str, bool], tuple[bool, int]]


def json_step(fragment: str, inside: bool) -> tuple[bool, int]:
    """A stretch of JSON and the ``}`` behind it."""
    if "\\" in fragment:
        fragment = ESCAPED.sub("", fragment)
    parts = fragment.split('"')
    after = inside ^ (len(parts) % 2 == 0)
    opened = sum(part.count("{") for part in parts[inside::2])
    return after, opened - (not after)


def csv_step(line: str, inside: bool) -> tuple[bool, int]:
    """A line of CSV; a doubled quote changes nothing."""
    return inside ^ (line.count('"') % 2 == 1), 0


def _fragments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").alias("fragment"),
    )


def _split_states(fragments: DataFrame, step: Step) -> DataFrame:
    """Per split ``inside`` and ``depth`` at its start, its ``bytes`` with separators and ``first``
    character."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, totals, size, first, whole = None, [], 0, "", 0

        def row() -> pa.RecordBatch:
            (flips, up), (_, down) = totals
            values = (*key, flips, up, down, size, first, whole)
            names = ("file", "split", "flips", "up", "down", "bytes", "first", "file_size")
            return pa.RecordBatch.from_pydict({name: [value] for name, value in zip(names, values)})

        for batch in batches:
            names = (batch.column(n).to_pylist() for n in ("file", "split", "fragment", "octets", "file_size"))
            for file, split, fragment, octets, file_bytes in zip(*names):
                if (file, split) != key:
                    if key:
                        yield row()
                    key, totals, size, whole = (file, split), [(False, 0), (True, 0)], 0, file_bytes
                    first = fragment.lstrip(BLANK)[:1]
                size += octets + 1
                stepped = [step(fragment, inside) for inside, _ in totals]
                totals = [(inside, depth + change) for (inside, change), (_, depth) in zip(stepped, totals)]
        if key:
            yield row()

    schema = "file STRING, split BIGINT, flips BOOLEAN, up BIGINT, down BIGINT, bytes BIGINT, first STRING, file_size BIGINT"
    octets = F.octet_length("fragment").cast("bigint").alias("octets")
    splits = fragments.select("file", "split", "fragment", octets, "file_size").mapInArrow(sums, schema)
    folder = work_folder(fragments.sparkSession, "splits")
    splits.write.parquet(folder)
    splits = fragments.sparkSession.read.parquet(folder)
    # One narrow row per split of a file.
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum(F.col("flips").cast("int")).over(earlier), F.lit(0))
    known = splits.withColumn("inside", flips % 2 == 1)
    change = F.when(F.col("inside"), F.col("down")).otherwise(F.col("up"))
    known = known.withColumn("change", change)
    return known.withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))


def _cut(fragments: DataFrame, states: DataFrame, step: Step, separator: str, bare: Callable[[str], str]) -> DataFrame:
    """(file, split, no, kind, text): whole records, and parts of those that cross splits."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, no, held, kind = None, False, 0, 0, [], WHOLE
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["file", "split", "no", "kind", "text"])

        def leave() -> None:
            if held:  # the record goes on in the next split
                rows.append((*key, no, TAIL if kind == WHOLE else MORE, separator.join(held) + separator))

        for batch in batches:
            names = ("file", "split", "fragment", "inside", "depth")
            for file, split, fragment, start_inside, start_depth in zip(*(batch.column(n).to_pylist() for n in names)):
                if (file, split) != key:
                    leave()
                    key, inside, depth, no, held = (file, split), start_inside, start_depth, 0, []
                    kind = MORE if inside or depth else WHOLE
                if not held and kind == WHOLE:
                    fragment_kept = bare(fragment)
                else:
                    fragment_kept = fragment
                inside, change = step(fragment, inside)
                depth += change
                if depth < 0:  # nothing was open: what stands behind the last record
                    rows.append((*key, no, END, fragment))
                    depth, no = 0, no + 1
                    continue
                held.append(fragment_kept)
                if not inside and depth == 0:
                    rows.append((*key, no, kind, separator.join(held) + (separator if separator == "}" else "")))
                    held, kind, no = [], WHOLE, no + 1
            if len(rows) >= 5_000:
                yield batch_of()
        leave()
        yield batch_of()

    schema = "file STRING, split BIGINT, no BIGINT, kind STRING, text STRING"
    known = states.select("file", "split", "inside", "depth")
    if known.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        known = F.broadcast(known)
        return fragments.join(known, ["file", "split"]).mapInArrow(cut, schema)
    # Beyond that, the fragments of a split meet their state in one task, in their order.
    placed = fragments.withColumn("tag", F.monotonically_increasing_id())
    joined = placed.join(known, ["file", "split"]).repartition("file", "split")
    return joined.sortWithinPartitions("file", "split", "tag").drop("tag").mapInArrow(cut, schema)


def _records(
    spark: SparkSession, path: str, separator: str, step: Step, bare: Callable[[str], str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records in one piece, all that was cut (written once), and the states of the splits."""
    fragments = _fragments(spark, path, separator)
    states = _split_states(fragments, step)
    folder = work_folder(spark, "records")
    _cut(fragments.drop("file_size"), states, step, separator, bare).write.parquet(folder)
    cut = spark.read.parquet(folder)
    parts = cut.where(F.col("kind").isin(TAIL, MORE))
    order = Window.partitionBy("file").orderBy("split", "no")
    parts = parts.withColumn("group", F.count_if(F.col("kind") == TAIL).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("split", "no", "text")))
    crossing = parts.groupBy("file", "group").agg(
        F.min(F.struct("split", "no")).alias("at"), F.array_join(pieces["text"], "").alias("text")
    )
    whole = cut.where(F.col("kind") == WHOLE).select("file", "split", "no", "text")
    return whole.unionByName(crossing.select("file", "at.split", "at.no", "text")), cut, states


def _refuse_broken_arrays(cut: DataFrame, states: DataFrame) -> None:
    """Raise for a file with stray text behind an object, or without its end."""
    ends = cut.where(F.col("kind") == END).select("file", "split", "no", "text")
    last = cut.groupBy("file").agg(F.max(F.struct("split", "no")).alias("last"))
    tail = F.regexp_replace("text", r"\s", "")
    early = F.struct("split", "no") < F.col("last")
    stray = ends.join(last, "file").where(early | ~tail.isin("", "]", "[]"))
    if first := stray.first():
        raise ValueError(f"{first['file']} is no array of objects: stray text {first['text'][:40]!r}")
    files = states.groupBy("file").agg(
        F.sum("bytes").alias("bytes"), F.max("file_size").alias("file_size"),
        F.min(F.struct("split", "first"))["first"].alias("first"),
    )
    closing = ends.select("file", F.contains("text", F.lit("]")).alias("closed"))
    files = files.join(closing, "file", "left")
    # One byte more than the file has: behind its last object there is no separator.
    unended = (F.col("bytes") > F.col("file_size")) & F.col("closed").isNull()
    unclosed = (F.col("first") == "[") & ~F.coalesce("closed", F.lit(False))
    if first := files.where(unended | unclosed).first():
        raise ValueError(f"{first['file']} has no end")


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON files, each an array of objects or one: ``file``, ``split``, ``no``, ``text``.

    (``split``, ``no``) is their order within a file.  A file that ends inside an object, or has
    anything but white space, commas and the array's brackets between objects, raises.
    """

    def bare(fragment: str) -> str:
        found = fragment.find("{")
        before, rest = (fragment, "") if found < 0 else (fragment[:found], fragment[found:])
        if found >= 0 and before.strip(BLANK) not in ("", "[", ","):
            raise ValueError(f"no array of objects: stray text {before[:40]!r}")
        return rest

    records, cut, states = _records(spark, path, "}", json_step, bare)
    _refuse_broken_arrays(cut, states)
    return records


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files, quoted line breaks inside: ``file``, ``split``, ``no``, ``text``.

    A file that ends inside a quoted cell raises.
    """
    rows, _, _ = _records(spark, path, "\n", csv_step, lambda line: line)
    odd = F.length(F.regexp_replace("text", '[^"]', "")) % 2 == 1
    wrong = F.raise_error(F.concat(F.lit("a record has no end: "), F.left("text", F.lit(80))))
    text = F.when(odd, wrong).otherwise(F.regexp_replace("text", r"\r\z", ""))
    return rows.withColumn("text", text)
