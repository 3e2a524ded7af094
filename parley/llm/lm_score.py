"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens.  A chunk's bytes are cut and hashed as arrays: a word's hash is a polynomial in
its bytes, modulo 2**64, so no word becomes a Python object unless it is written.

Chunks.  The documents are written once as packed chunks of about ``CHUNK_BYTES`` of text,
which all later steps read.

Counting.  Tasks count the hashes of words and word pairs of their chunks' training documents
and send the hashes, dealt by their leading bits into segments of bounded
size; a chunk sends rows to the segments it has n-grams of only.  A segment adds up its counts and inserts each n-gram once per level
``1 .. 1 + floor(log2(count))`` into a Bloom filter of its own.  The number of segments
follows the number of training tokens, so no task ever holds more than about
``SEGMENT_TOKENS`` n-grams.

Scoring.  N-grams of held-out documents are dealt to the segments too, and a segment looks up
each n-gram that it was sent once, ``PASS_BYTES`` of hashes at a time, and answers every chunk.
So no filter is broadcast and no text is read once per part of the filter, however large that is.
An n-gram's level is found by probing level after level until one is missing; its
count is then the mean count of the level.  A pair's probability is the interpolation of
pair and word estimates.

Base scores need exact counts.  Those of the ``HEAD`` most frequent words are broadcast,
and all other words are joined with the full count table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stored
from parley.session import spread

ALPHA = 0.1
#: Weight of the pair estimate in the interpolation.
PAIR_WEIGHT = 0.3
HEAD = 150_000
SEGMENT_TOKENS = 2 << 20
#: Bytes of text (or one text) that are counted, and scored, at a time.
CHUNK_BYTES = 2 << 20
#: Bytes hashed at a time (or one word).
BLOCK = 1 << 19
#: Bytes of hashes that are put into a filter, or looked up, at a time.
PASS_BYTES = 1 << 19
#: Bits per inserted level, and probes for each.
BITS, PROBES = 10, 4
CODEC = "zstd"
#: No word contains white space, so these stand for the end and the beginning.
END, BEGIN = b"\n", b"\t"
LEVELS = 64

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S = [np.uint64(x) for x in (30, 27, 31)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit hashes."""
    h = (h ^ (h >> _S[0])) * _M2
    h = (h ^ (h >> _S[1])) * _M3
    return h ^ (h >> _S[2])


class _Bytes:
    """Value of each byte (none for white space, A to Z as a to z), and powers of an odd
    number and of its inverse, as many as were asked for."""

    def __init__(self):
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * _M1)
        self.value[[9, 10, 11, 12, 13, 32]] = 0
        self.value[65:91] = self.value[97:123]
        self.base = int(_M2) | 1
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (
                np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (self.base, inverse)
            )
        return self.up, self.down


_bytes = _Bytes()
_space = _bytes.value == 0
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] = _lower[97:123]
_END_HASH, _BEGIN_HASH = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def word_hashes(data: np.ndarray, starts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Hashes of the words that begin at ``starts`` and end at white space or the next start."""
    out = np.empty(len(starts), np.uint64)
    ends = np.append(starts[1:], len(data))
    at = 0
    while at < len(starts):
        until = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
        first, last = int(starts[at]), int(ends[until - 1])
        up, down = _bytes.powers(max(block, last - first))
        own = starts[at:until] - first
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_bytes.value[data[first:last]] * up[: last - first], own)
            out[at:until] = mix(sums * down[own])
        at = until
    return out


class Tokens:
    """The tokens of some texts: words and one end each.

    ``hashes`` of all tokens, ``starts`` and ``sizes`` of the texts in tokens.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = _space[data]
        begins = ~space
        begins[1:] &= space[:-1]
        texts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[texts] = ~space[texts]
        words = np.flatnonzero(begins)
        ends = np.searchsorted(words, offsets[1:])
        last = ~space
        last[:-1] &= space[1:] | begins[1:]
        self.data, self.words, self.until = data, words, np.flatnonzero(last) + 1
        self.hashes = np.insert(word_hashes(data, words), ends, _END_HASH)
        self.sizes = np.diff(ends, prepend=0) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at = np.insert(np.arange(len(words)), ends, -1)

    def written(self, which: np.ndarray) -> pa.StringArray:
        """The tokens at some places, as written in lower case."""
        at = self.at[which]
        begin = np.where(at < 0, 0, np.append(self.words, 0)[at])
        sizes = np.where(at < 0, len(END), np.append(self.until, 0)[at] - begin)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], sizes)
        if len(self.data):
            content = _lower[self.data[np.minimum(places, len(self.data) - 1)]]
        else:
            content = np.zeros(offsets[-1], np.uint8)
        content[offsets[:-1][at < 0]] = END[0]
        buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(content)]
        return pa.StringArray.from_buffers(len(which), buffers[1], buffers[2])


def runs(texts: pa.Array, size: int):
    """First row, bytes and offsets of runs of texts with about ``size`` bytes, or one text; null is the empty text."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, content = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1)
        end = min(end, len(texts))
        yield begin, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def chunks(texts: pa.Array, size: int):
    """First row and tokens of runs of texts."""
    for begin, data, offsets in runs(texts, size):
        yield begin, Tokens(data, offsets)


def packed(docs: DataFrame) -> DataFrame:
    """One row per chunk: uid of its first document, doc_ids, which are learned, sizes in bytes, and the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches):
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.columns
            for begin, data, offsets in runs(texts, CHUNK_BYTES):
                n = len(offsets) - 1
                own = ids.slice(begin, n)
                learned = bytes(not is_held_out(i) for i in own.to_pylist())
                text = pa.compress(data.tobytes(), codec=CODEC, asbytes=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), own),
                     *(pa.array([x], pa.binary()) for x in (learned, np.diff(offsets).tobytes(), text))],
                    ["chunk", "doc_ids", "learned", "sizes", "text"],
                )
                uid += n

    return docs.select("doc_id", "text").mapInArrow(
        pack, f"chunk long, doc_ids array<{kind}>, learned binary, sizes binary, text binary"
    )


def unpacked(learned: pa.Scalar, sizes: pa.Scalar, text: pa.Scalar, only_learned: bool = False) -> tuple[Tokens, np.ndarray]:
    """Tokens of a chunk, or of its training documents, and whether each token is learned."""
    learned, sizes = np.frombuffer(learned.as_py(), bool), np.frombuffer(sizes.as_py(), np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(pa.decompress(text.as_buffer(), int(offsets[-1]), codec=CODEC), np.uint8)
    if only_learned and not learned.all():
        data, sizes, learned = data[np.repeat(learned, sizes)], sizes[learned], learned[learned]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    tokens = Tokens(data, offsets)
    return tokens, np.repeat(learned, tokens.sizes)


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A to Z in lower case, and one end; null is the empty text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def is_held_out(doc_id) -> bool:
    """A null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def pairs_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the pairs that end at each word."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts] = _BEGIN_HASH
    with np.errstate(over="ignore"):
        return mix(before * _M1 + hashes)


def single_of(hashes: np.ndarray) -> np.ndarray:
    """Hashes of words as n-grams of their own."""
    with np.errstate(over="ignore"):
        return mix(hashes ^ _M3)


def word_counts(packs: DataFrame) -> DataFrame:
    """word and its count c in the training documents of the chunks."""

    def count(batches):
        for batch in batches:
            for row in zip(*batch.columns):
                tokens, _ = unpacked(*row, only_learned=True)
                _, first, times = np.unique(tokens.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([tokens.written(first), pa.array(times, pa.int64())], ["word", "c"])

    counted = packs.select("learned", "sizes", "text").mapInArrow(count, "word string, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def grams(hashes: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, how often each is learned, and which of them each given one is."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    which = np.empty(len(ranked), np.int64)
    which[order] = np.cumsum(new) - 1
    times = np.add.reduceat(learned[order].astype(np.int64), first) if len(first) else first
    return ranked[first], times, which


def chunk_grams(tokens: Tokens, learned: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``grams`` of the words, as n-grams of their own, and of the pairs of a chunk."""
    words, times, at = grams(tokens.hashes, learned)
    single = single_of(words)
    order = np.argsort(single)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return [(single[order], times[order], rank[at]), grams(pairs_of(tokens.hashes, tokens.starts), learned)]


#: Binary columns of n-gram hashes by kind, learned once or otherwise, and counts of the latter.
_HASHES, _TIMES = ["once1", "more1", "once2", "more2"], ["times1", "times2"]


def _binaries(values: np.ndarray, edges: np.ndarray) -> pa.BinaryArray:
    """Runs of values between edges, as binaries."""
    places = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(values))]
    )


def _joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binaries of a column, and their edges."""
    array = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(array):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, places, content = array.buffers()
    wide = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    edges = np.frombuffer(places, wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    if edges[0] == edges[-1]:
        return np.zeros(0, kind), np.zeros(len(edges), np.int64)
    return np.frombuffer(content, kind, (edges[-1] - edges[0]) // size, edges[0]), (edges - edges[0]) // size


def _blobs(packs: DataFrame, bits: int) -> DataFrame:
    """Per chunk and segment the n-gram hashes learned once, and the others with their counts, 0 if only held out."""

    def run(batches):
        count = 1 << bits
        begins = np.arange(1, count, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
        for batch in batches:
            for chunk, *row in zip(*batch.columns):
                columns = [pa.array(np.arange(count), pa.int32()), pa.array(np.full(count, chunk.as_py()))]
                some = np.zeros(count, bool)
                counts = []
                for found, times, _ in chunk_grams(*unpacked(*row)):
                    for own in (times == 1, times != 1):
                        hashes = found[own]
                        edges = np.concatenate([[0], np.searchsorted(hashes, begins), [len(hashes)]])
                        columns.append(_binaries(hashes, edges))
                        some |= edges[1:] > edges[:-1]
                    counts.append(_binaries(times[own].astype("<u4"), edges))
                made = pa.RecordBatch.from_arrays(columns + counts, ["segment", "chunk", *_HASHES, *_TIMES])
                yield made.filter(pa.array(some))

    columns = ", ".join(f"{n} binary" for n in [*_HASHES, *_TIMES])
    read = packs.select("chunk", "learned", "sizes", "text")
    return read.mapInArrow(run, f"segment int, chunk long, {columns}")


def positions(hashes: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """Bits that stand for a level of each n-gram; one row per probe."""
    with np.errstate(over="ignore"):
        first = mix(hashes + np.uint64(level) * _M1)
        step = (first >> np.uint64(32)) | np.uint64(1)
        return np.stack([(first + np.uint64(i) * step) % size for i in range(PROBES)])


def _counted(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-grams, their counts, and which of them each given one is."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    which = np.empty(len(ranked), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ranked[first], np.add.reduceat(weights[order], first) if len(first) else weights, which


def _runs(n: int) -> list[slice]:
    """Slices of n hashes, of ``PASS_BYTES`` each."""
    step = max(1, PASS_BYTES // 8)
    return [slice(begin, begin + step) for begin in range(0, n, step)]


def _segment(rows: list[dict], placed: list | None = None) -> tuple[bytes, list[list[int]]]:
    """Filter of one segment, and per kind the n-grams and counts on each level.

    ``placed`` gets per kind the distinct n-grams, and which of them each one in the rows
    is: those met once before the others.
    """
    tallies, counted = [], []
    for kind in (1, 2):
        own = [r for r in rows if r["kind"] == kind]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[n], np.uint64) for n in ("once", "more") for r in own)])
        times = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["times"], "<u4") for r in own)])
        weights = np.concatenate([np.ones(len(hashes) - len(times), np.int64), times])
        found, counts, which = _counted(hashes, weights)
        levels = np.frexp(counts.astype(float))[1]
        tallies.append(np.bincount(levels, minlength=LEVELS)[:LEVELS].tolist())
        tallies.append(np.bincount(levels, weights=counts, minlength=LEVELS)[:LEVELS].astype(int).tolist())
        counted.append((found, levels))
        if placed is not None:
            placed.append((found, which))
    entries = int(sum(levels.sum() for _, levels in counted))
    size = 64 * max(1, -(-entries * BITS // 64))
    bits = np.zeros(size, bool)
    for hashes, levels in counted:
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = hashes[levels >= level]
            for run in _runs(len(own)):
                bits[positions(own[run], level, np.uint64(size)).ravel()] = True
    return np.packbits(bits).tobytes(), tallies


def answered(table: pa.Table) -> pa.Table:
    """The levels of all n-grams that were sent to a segment, by chunk; the tallies stand in the first row."""
    rows, edges, placed = [], [], []
    for kind in (1, 2):
        (once, a), (more, b) = (_joined(table[f"{n}{kind}"], np.uint64) for n in ("once", "more"))
        rows.append({"kind": kind, "once": once, "more": more, "times": _joined(table[f"times{kind}"], "<u4")[0]})
        edges.append((a, b))
    data, tallies = _segment(rows, placed)
    held = Filter(0, {0: data})
    columns = [table["segment"], table["chunk"]]
    for (found, which), (once, more) in zip(placed, edges):
        levels = held.looked_up(0, found)[which]
        columns += [_binaries(levels[: once[-1]], once), _binaries(levels[once[-1] :], more)]
    rest = [None] * (len(table) - 1)
    columns.append(pa.array([tallies, *rest], pa.list_(pa.list_(pa.int64()))))
    return pa.Table.from_arrays(columns, ["segment", "chunk", *_HASHES, "tallies"])


class Filter:
    """Some segments of the filter, probed for whole arrays of n-gram hashes."""

    def __init__(self, bits: int, segments: dict[int, bytes]):
        self.bits = bits
        self.segments = {n: np.frombuffer(d, np.uint8) for n, d in segments.items()}

    def looked_up(self, number: int, hashes: np.ndarray) -> np.ndarray:
        """Level of each n-gram of one segment."""
        data, out = self.segments[number], np.zeros(len(hashes), np.uint8)
        for run in _runs(len(hashes)):
            active = np.arange(run.start, min(run.stop, len(hashes)))
            for level in range(1, LEVELS):
                if not len(active):
                    break
                alive = np.ones(len(active), bool)
                for row in positions(hashes[active], level, np.uint64(8 * len(data))):
                    byte = data[(row >> np.uint64(3)).astype(np.int64)]
                    alive &= (byte >> (7 - (row & np.uint64(7))).astype(np.uint8)) & 1 == 1
                active = active[alive]
                out[active] = level
        return out

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each n-gram, 0 where its segment is not held."""
        found, back = np.unique(hashes, return_inverse=True)
        out = np.zeros(len(found), np.uint8)
        where = found >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(found), np.uint64)
        for number in self.segments:
            begin, end = np.searchsorted(where, [number, number + 1])
            out[begin:end] = self.looked_up(number, found[begin:end])
        return out[back]


class LanguageModel:
    """What scoring needs: the count table, its head, the levels of the chunks' n-grams and level means."""

    def __init__(self, packs: DataFrame):
        spark = packs.sparkSession
        self.counts = stored(word_counts(packs), "words")
        total = self.counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.types = total["n"] or 0, total["v"]
        self.documents = self.counts.where(F.col("word") == END.decode()).select("c").first()
        self.documents = self.documents["c"] if self.documents else 0
        # the head ends at a step of the counts, found on a histogram of a few hundred rows
        step = F.floor(F.log2("c") * 8)
        steps = self.counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
        self.least_step, held = 1 << 30, 0
        for row in sorted(steps, reverse=True):
            held += row["n"]
            if held > HEAD:
                break
            self.least_step = row["step"]
        head = self.counts.where(step >= self.least_step).select("word", "c")
        sink = pa.BufferOutputStream()
        table = head.toArrow()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.head = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        self.tail = self.counts.where(step < self.least_step)
        self.bits = max(0, math.ceil(math.log2(max(1, self.tokens) / SEGMENT_TOKENS)))

        def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return answered(table)

        columns = ", ".join(f"{n} binary" for n in _HASHES)
        schema = f"segment int, chunk long, {columns}, tallies array<array<bigint>>"
        answers = _blobs(packs, self.bits).groupBy("segment").applyInArrow(answer, schema)
        self.levels = stored(answers, "levels")
        tallies = self.levels.select(F.posexplode(F.flatten("tallies")).alias("at", "n"))
        means = np.zeros(4 * LEVELS)
        for row in tallies.groupBy("at").agg(F.sum("n").alias("n")).collect():  # 4 * LEVELS rows
            means[row["at"]] = row["n"]
        means = means.reshape(4, LEVELS)
        with np.errstate(invalid="ignore", divide="ignore"):
            guess = np.r_[0.0, 2.0 ** np.arange(LEVELS - 1)]
            self.single = np.where(means[0] > 0, means[1] / means[0], guess)
            self.pair = np.where(means[2] > 0, means[3] / means[2], guess)


def head_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the head's words, and their counts."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    if not len(table):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words, counts = table["word"].combine_chunks(), table["c"].to_numpy()
    if isinstance(words, pa.ChunkedArray):
        words = pa.concat_arrays(words.chunks)
    # each word is a text of one word and an end; the end itself is a text without words
    hashes = np.concatenate([tokens.hashes[tokens.starts] for _, tokens in chunks(words, CHUNK_BYTES)])
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def counts_of(words: np.ndarray, head: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Head counts of word hashes, 0 outside the head."""
    hashes, counts = head
    if not len(hashes):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    return np.where(hashes[at] == words, counts[at], 0)


def log_probabilities(pair, word, before, model_means, tokens: int, types: int) -> np.ndarray:
    """log10 of the interpolated probability from the three levels of each token.

    ``before`` holds the counts of the preceding words.
    """
    single, pairs = model_means
    lower = (single[word] + ALPHA) / (tokens + ALPHA * (types + 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        upper = np.where(before > 0, np.minimum(1.0, pairs[pair] / np.maximum(before, 1e-9)), 0.0)
    weight = np.where(before > 0, PAIR_WEIGHT, 0.0)
    return np.log10(weight * upper + (1 - weight) * lower)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document.

    ``docs`` needs doc_id and text; other columns are left out.  The model learns from
    the rows whose id is not held out; null ids are not held out.  Null and empty texts
    have the end alone.  Repeated rows count, and are scored, one by one.  An empty
    table gives none; with nothing to learn from, every probability is 1 / (V + 1).
    """
    docs = spread(docs.select("doc_id", "text"))
    packs = stored(packed(docs), "lm-chunks")
    model = LanguageModel(packs)
    head = model.head
    tokens, types, documents = model.tokens, model.types, model.documents
    means, share = (model.single, model.pair), ALPHA / (tokens + ALPHA * (types + 1))
    kind = docs.schema["doc_id"].dataType
    out = (
        f"uid long, doc_id {kind.simpleString()}, n_tokens long, head_known long, head_base double,"
        " score double, tail array<struct<word:string,n:bigint>>"
    )
    known = []  # once per task

    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not known:
            known.append(head_counts(head.value))
        part, learned = unpacked(*(left[n][0] for n in ("learned", "sizes", "text")))
        ids, uid = pa.concat_arrays([x.flatten() for x in left["doc_ids"].chunks]), key[0].as_py()
        n, starts, sizes = len(part.sizes), part.starts, part.sizes
        right = right.sort_by("segment")
        both, kinds = [], chunk_grams(part, learned)
        which_word = kinds[0][2]
        for k, (found, times, which) in enumerate(kinds, 1):
            levels = np.empty(len(found), np.uint8)
            levels[times == 1], levels[times != 1] = (_joined(right[f"{x}{k}"], np.uint8)[0] for x in ("once", "more"))
            both.append(levels[which])
        word, pair = both
        previous = np.empty(len(word))
        previous[1:] = means[0][word[:-1]]
        previous[starts] = documents
        logs = log_probabilities(pair, word, previous, means, tokens, types)
        # each distinct word is looked for once
        one = np.empty(which_word.max() + 1, np.int64)
        one[which_word] = np.arange(len(which_word))
        counts = counts_of(part.hashes[one], known[0])
        base = np.where(counts > 0, np.log10((counts / ALPHA + 1) * share), 0.0)[which_word]
        counts = counts[which_word]
        return pa.Table.from_arrays(
            [pa.array(np.arange(uid, uid + n)), ids, pa.array(sizes, pa.int64()),
             pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
             pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts)),
             _tails(part, counts == 0)],
            ["uid", "doc_id", "n_tokens", "head_known", "head_base", "score", "tail"],
        )

    answers = model.levels.drop("tallies").groupBy("chunk")
    rows = stored(packs.groupBy("chunk").cogroup(answers).applyInArrow(score, out), "lm-scores")
    head.destroy()
    tail = rows.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.n")
    log = F.log10((F.coalesce(F.col("c"), F.lit(0)) / ALPHA + 1) * share)
    sums = (
        tail.join(model.tail, "word", "left")
        .groupBy("uid")
        .agg(F.sum(F.col("n") * log).alias("tail_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    )
    return rows.drop("tail").join(sums, "uid", "left").select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _tails(tokens: Tokens, outside: np.ndarray) -> pa.ListArray:
    """Per text its words outside the head with their times."""
    which = np.flatnonzero(outside)
    rows = np.searchsorted(tokens.starts, which, side="right") - 1
    order = np.lexsort((tokens.hashes[which], rows))
    which, rows = which[order], rows[order]
    hashes = tokens.hashes[which]
    new = np.ones(len(which), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(which)))
    words = pa.StructArray.from_arrays(
        [tokens.written(which[first]), pa.array(times, pa.int64())], ["word", "n"]
    )
    ends = np.searchsorted(rows[first], np.arange(len(tokens.sizes) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)
