"""Bounded-space online packing of tokenised documents into windows of fixed length.

Each task keeps a fixed number of open windows.  A document is cut into full windows
and a rest; the rest goes to the open window it fits best.  When none fits and no more
windows may be opened, the fullest window is filled up with the head of the rest and
emitted, so every emitted window is full.  What stays open at the end of a task is
merged in further rounds over ever fewer tasks (``FAN_IN`` tasks' leftovers meet in
one), until one task is left; only its last open windows carry padding.

A task holds ``open_windows`` windows of ids and one document.  The result of each
round is written once to the shared folder, so the pieces of a window always come from
the same run of a task, also when executors are lost.
"""

from __future__ import annotations

import json
import zlib
from functools import reduce

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.bpe import codec
from parley.session import spread, work_folder

WINDOW = 1024
OPEN_WINDOWS = 16
#: Tasks whose leftovers are merged by one task of the next round.
FAN_IN = 16
#: Id that closes each document.
SEPARATOR = 0

PIECES = (
    "doc_id {type}, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long, part int, ids binary"
)
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Open windows of one task; ``emit`` receives finished windows as lists of pieces.

    A piece is [doc_id, start, ids as bytes, document's tokens].
    """

    def __init__(self, emit, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.emit, self.window, self.most = emit, window, open_windows
        self.open: list[list] = []
        self.gaps: list[int] = []

    def _put(self, at: int, piece: list, size: int) -> None:
        self.open[at].append(piece)
        self.gaps[at] -= size
        if not self.gaps[at]:
            self.emit(self.open.pop(at))
            self.gaps.pop(at)

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        """Place ids (4 bytes each), which begin at ``start`` of their document."""
        at, end, step = 0, len(ids), 4 * self.window
        while end - at >= step:
            self.emit([[doc_id, start + at // 4, ids[at : at + step], doc_tokens]])
            at += step
        while at < end:
            size = (end - at) // 4
            fitting = [(gap, i) for i, gap in enumerate(self.gaps) if gap >= size]
            if fitting:
                gap, best = min(fitting)
            elif len(self.open) < self.most:
                self.open.append([])
                self.gaps.append(self.window)
                best = len(self.open) - 1
            else:
                size = min(self.gaps)
                best = self.gaps.index(size)
            stop = at + 4 * size
            self._put(best, [doc_id, start + at // 4, ids[at:stop], doc_tokens], size)
            at = stop


def _rows(kind: pa.DataType, first_sequence: int, part: int, window: int, most: int, last: bool):
    """A packer with a function that turns what it has emitted into an Arrow batch."""
    done: list[tuple] = []
    count = 0

    def emit(pieces: list, keep: bool = False) -> None:
        nonlocal count
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            size = len(ids) // 4
            done.append(
                (doc_id, start, size, zlib.crc32(ids), doc_tokens, first_sequence + count,
                 offset, part, ids if keep else None)
            )
            offset += size
        count += 1

    packer = Packer(emit, window, most)

    def take(end: bool = False) -> pa.RecordBatch:
        if end:
            for pieces in packer.open:
                emit(pieces, keep=not last)
        columns = list(zip(*done)) or [()] * 9
        done.clear()
        kinds = [kind, *[pa.int64()] * 6, pa.int32(), pa.binary()]
        names = [*RESULT, "part", "ids"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names
        )

    return packer, take


def document_encoder(path: str):
    """Function from a text to its ids as bytes, special tokens of the file included."""
    with open(path, encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    own = codec(path)
    whole = tiktoken.Encoding(
        "packing",
        pat_str=own.pattern,
        mergeable_ranks={t: i for i, t in enumerate(own.tokens) if t and i not in special.values()},
        special_tokens=special,
    )
    return lambda text: whole.encode_to_numpy(text, allowed_special="all").tobytes() if text else b""


def pack_documents(
    docs: DataFrame,
    path: str,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Pieces of all documents' ids, each document closed by ``SEPARATOR``.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32 (of
    the ids as little-endian 32-bit numbers), doc_tokens, sequence_id and offset in the
    sequence.  Every id lies in exactly one piece; sequences are gapless from 0 and at
    most ``window`` long.  Null and empty texts are the separator alone; repeated rows
    and null ids are packed as they come; an empty table gives no pieces; other columns
    are left out.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = PIECES.format(type=kind)
    closing = SEPARATOR.to_bytes(4, "little")

    def pack(batches):
        part = TaskContext.get().partitionId()
        encode, tools = None, None
        for batch in batches:
            if tools is None:
                encode = document_encoder(path)
                tools = _rows(batch.schema.field(0).type, part << 32, part, window, open_windows, False)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + closing
                tools[0].add(doc_id, 0, ids, len(ids) // 4)
            yield tools[1]()
        if tools is not None:
            yield tools[1](end=True)

    def merge(level: int, last: bool):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            part = key[0].as_py()
            first = (level << 56) | (part << 32)
            most = 1 if last else open_windows
            packer, take = _rows(table.schema.field(0).type, first, part, window, most, last)
            table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            for row in table.to_pylist():
                packer.add(row["doc_id"], row["start"], row["ids"], row["doc_tokens"])
            return pa.Table.from_batches([take(end=True)])

        return run

    spread(docs.select("doc_id", "text")).mapInArrow(pack, schema).write.parquet(f"{folder}/0")
    rounds = [spark.read.parquet(f"{folder}/0")]
    parts = 1 + (rounds[0].where("ids is not null").agg(F.max("part")).first()[0] or 0)
    while True:
        level = len(rounds)
        parts = -(-parts // FAN_IN)
        grouped = (
            rounds[-1]
            .where("ids is not null")
            .withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
            .groupBy("part")
        )
        grouped.applyInArrow(merge(level, parts == 1), schema).write.parquet(f"{folder}/{level}")
        rounds.append(spark.read.parquet(f"{folder}/{level}"))
        if parts == 1:
            break
    return reduce(DataFrame.unionByName, rounds).where("ids is null").select(*RESULT)


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, ids, and padding ids when sequences are filled to ``window``,
    except those whose length is a power of two."""
    sequences = pieces.groupBy("sequence_id").agg(F.sum("length").alias("size"))
    gap = F.when(F.bit_count("size") == 1, 0).otherwise(window - F.col("size"))
    return sequences.agg(
        F.count("*").alias("sequences"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("ids"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("padding"),
    )
