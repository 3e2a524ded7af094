"""Near duplicates by order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence
number, thinned to the ``SAMPLE`` smallest under one hash.  A sketch element takes the
``PICKED`` smallest of them under a hash of its own and keeps them in text order, so it
survives only where both the content and its order do.  Documents that share one of the
``BANDS`` elements are candidates; a pair is accepted if an alignment of the words of
the whole texts matches at least ``THRESHOLD`` of the longer one's words in order.

Equal texts are first folded into one.  Every candidate is compared with the first and
the last member of its bucket, which joins groups of copies of any size.  Then every pair
of a bucket whose texts are still of two classes is looked at, in blocks of up to
``CLASSES`` members: it is compared unless its lengths, or the words that the texts can
have in common, keep it below the threshold.  What texts can have in common is read off
bit sets of their words, which never say less than there is, so no pair is lost.  The best
pair of each two classes is compared first, and then the pairs whose classes that has not
joined.  Classes are thus the connected components of all candidates that align.  Only
bit sets meet in the square of a bucket's size, and a task holds two blocks at a time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import SALTS, stored
from parley.session import spread

SHINGLE = 5
THRESHOLD = 0.8
#: Shingles that a text is thinned to, those of an element, and elements of a text.
SAMPLE = 64
PICKED = 3
BANDS = 40
#: Members of a bucket's block; classes of larger buckets are looked at block by block.
CLASSES = 512
#: Bytes of bit sets of a block, for which blocks of long texts have fewer members.
BLOCK_BYTES = 4 << 20
#: Lengths whose logarithms to this base have equal floors are of one group; texts of
#: groups that are no neighbours are too unlike in length.
LENGTHS = 1.26
#: Words of one text that are aligned at a time.
BLOCK = 1024

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_32, _29 = np.uint64(32), np.uint64(29)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _32)) * _M2
    h = (h ^ (h >> _29)) * _M3
    return h ^ (h >> _32)


_SEEDS = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _M1)


class Shingler:
    """Words to labelled shingle hashes; remembers word hashes up to a bound."""

    def __init__(self, most: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").lower().encode("utf-8", "replace").split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        found = list(map(self.known.get, words))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    found[i] = self.known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        return np.array(found, np.uint64)

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Hash of each run of five words; shorter texts are one shingle."""
        hashes = self.hashes(words)
        size = min(SHINGLE, len(hashes))
        if not size:
            return hashes
        out = np.full(len(hashes) - size + 1, size, np.uint64)
        for i in range(size):
            out = _mix(out * _M1 + hashes[i : len(hashes) - size + 1 + i])
        return out

    def labelled(self, words: list[bytes]) -> np.ndarray:
        """Shingles told apart by their occurrence number."""
        return numbered(self.shingles(words))

    def bit_set(self, words: list[bytes]) -> np.ndarray:
        """A bit for each word, told apart by its occurrence number; halves as sets fold."""
        width = max(64, 1 << (8 * len(words) - 1).bit_length())
        places = numbered(self.hashes(words)) & np.uint64(width - 1)
        bits = np.zeros(width, np.uint8)
        bits[places.astype(np.int64)] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)


def numbered(plain: np.ndarray) -> np.ndarray:
    """Hashes told apart by their occurrence number."""
    order = np.argsort(plain, kind="stable")
    runs = plain[order]
    first = np.r_[True, runs[1:] != runs[:-1]] if len(runs) else np.zeros(0, bool)
    if first.all():
        return plain
    start = np.maximum.accumulate(np.where(first, np.arange(len(runs)), 0))
    number = np.empty(len(runs), np.uint64)
    number[order] = (np.arange(len(runs)) - start).astype(np.uint64)
    # first ones keep their hashes, so that a text without repeats is labelled like any other
    return np.where(number > 0, _mix(plain + number * _M1), plain)


def sampled(shingles: np.ndarray) -> np.ndarray:
    """The ``SAMPLE`` smallest shingles, in text order."""
    if len(shingles) <= SAMPLE:
        return shingles
    return shingles[np.sort(np.argpartition(shingles, SAMPLE - 1)[:SAMPLE])]


def bands(shingles: np.ndarray) -> np.ndarray:
    """Sketch elements of a text's thinned shingles; none without shingles."""
    size = min(PICKED, len(shingles))
    if not size:
        return np.zeros(0, np.int64)
    seeds = _SEEDS[:, None]
    ranks = (shingles[None, :] ^ seeds) * _M2
    ranks = (ranks ^ (ranks >> _32)) * _M3
    if size < len(shingles):
        picked = np.sort(np.argpartition(ranks, size - 1, axis=1)[:, :size], axis=1)  # text order
    else:
        picked = np.broadcast_to(np.arange(size), (len(ranks), size))
    element = _SEEDS.copy()
    for column in picked.T:
        element = _mix(element * _M1 + shingles[column])
    return element.view(np.int64)


def _bits(places: list[int], low: int, high: int) -> int:
    """A number with a bit for each of the sorted places from low to high."""
    inside = places[bisect_left(places, low) : bisect_left(places, high)]
    if len(inside) < 8:
        return sum(1 << (place - low) for place in inside)
    spots = np.zeros(high - low, np.uint8)
    spots[np.array(inside) - low] = 1
    return int.from_bytes(np.packbits(spots, bitorder="little").tobytes(), "little")


def aligned(a: list, b: list, threshold: float = THRESHOLD) -> float:
    """Words matched by the best alignment, as a share of the longer text's words.

    0 where the threshold cannot be reached.  Only words that stand within the band of
    shifts that the threshold allows are matched.  The alignment is carried as a row of
    bits: a cleared bit is a word of ``a`` where the longest match grows.
    """
    n, m = len(a), len(b)
    needed = threshold * max(n, m)
    if not n or not m or min(n, m) < needed:
        return 0.0
    head, tail, least = 0, 0, min(n, m)
    while head < least and a[head] == b[head]:
        head += 1
    while tail < least - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head : n - tail], b[head : m - tail]
    if head + tail + (Counter(a) & Counter(b)).total() < needed:
        return 0.0
    places = defaultdict(list)
    for place, word in enumerate(a):
        places[word].append(place)
    # words left out of either text are at most n + m - 2 * needed, and only they shift a match
    band = int(n + m - 2 * needed) + 1
    row = (1 << len(a)) - 1
    for at in range(0, len(b), BLOCK):
        low, high = max(0, at - band), min(len(a), at + BLOCK + band)
        if low >= high:
            break
        window = (1 << (high - low)) - 1
        part = (row >> low) & window
        row ^= part << low
        known: dict = {}
        for word in b[at : at + BLOCK]:
            bits = known.get(word)
            if bits is None:
                bits = known[word] = _bits(places[word], low, high) if word in places else 0
            grown = part & bits
            if grown:
                part = ((part + grown) | (part - grown)) & window
        row |= part << low
    return (head + tail + len(a) - row.bit_count()) / max(n, m)


def _sketched(docs: DataFrame) -> DataFrame:
    """uid, row (all columns but text), text, fp of the words, n words, bands."""
    others = [c for c in docs.columns if c != "text"]
    inner = docs.select(F.struct(*others).alias("row"), "text")

    def run(batches):
        tool = Shingler()
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            prints, sizes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                words = tool.words(text)
                if not words:
                    prints.append(None)
                    sizes.append(0)
                    keys.append([])
                    continue
                prints.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sizes.append(len(words))
                keys.append(bands(sampled(tool.labelled(words))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(uid, uid + len(sizes)), pa.int64()), batch.column(0), batch.column(1),
                 pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["uid", "row", "text", "fp", "n", "bands"],
            )
            uid += len(sizes)

    kind = inner.schema["row"].dataType.simpleString()
    schema = f"uid long, row {kind}, text string, fp binary, n long, bands array<bigint>"
    return inner.mapInArrow(run, schema)


def _accepted(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts align; each pair's texts meet in one row."""
    right = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        tool = Shingler()
        last, words = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            good = []
            for a, b, text_a, text_b in zip(*columns):
                if a != last:
                    last, words = a, tool.words(text_a)
                good.append(aligned(words, tool.words(text_b)) >= THRESHOLD)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "good"]
            )

    return joined.mapInArrow(run, "a long, b long, good boolean")


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the node that stands for all it is connected with, for all nodes of edges.

    Each round every node joins the first of its neighbours and itself, in an order drawn
    anew, and the edges are laid between those that nodes have joined.  Fewer nodes and
    edges are left each time, also of chains and stars.
    """
    edges = stored(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels: DataFrame | None = None
    turn = 0
    while labels is None or edges.limit(1).count():
        order = [F.struct(F.xxhash64(n, F.lit(turn)).alias("place"), F.col(n).alias("node")) for n in ("a", "b")]
        first = F.least(*order)
        ends = edges.select(F.explode(F.array("a", "b")).alias("node"), first.alias("first"))
        joined = ends.groupBy("node").agg(F.min("first").alias("first"))
        joined = stored(joined.select("node", F.col("first.node").alias("into")), "joined")
        if labels is None:
            labels = joined.withColumnRenamed("into", "comp")
        else:
            named = joined.select(F.col("node").alias("comp"), "into")
            labels = stored(
                labels.join(named, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), "labels"
            )
        near, far = (joined.select(F.col("node").alias(n), F.col("into").alias(f"into_{n}")) for n in ("a", "b"))
        laid = edges.join(near, "a").join(far, "b").where("into_a != into_b")
        low, high = F.least("into_a", "into_b"), F.greatest("into_a", "into_b")
        edges = stored(laid.select(low.alias("a"), high.alias("b")).distinct(), "edges")
        turn += 1
    return labels


def merged(comps: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The classes after some more edges: only classes that edges touch are joined anew."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if comps is None:
        base = nodes.withColumn("comp", F.col("node"))
    else:
        base = comps.unionByName(nodes.join(comps, "node", "leftanti").withColumn("comp", F.col("node")))
    base = stored(base, "classes")
    ends = [
        base.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}")) for n in ("a", "b")
    ]
    between = edges.select("a", "b").join(ends[0], "a").join(ends[1], "b").where("ca != cb")
    joined = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    joined = joined.select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    renamed = base.join(joined, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp"))
    return stored(renamed, "classes")


def _with_comp(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("uid"))
    named = comps.withColumnRenamed("node", "uid")
    return members.join(named, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))


def _met(members: DataFrame, some: DataFrame) -> DataFrame:
    """Members joined with the rows of ``some`` that have their key; no key lands in one task."""
    some = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", (F.col("uid") % SALTS).cast("int")).join(some, ["key", "salt"]).drop("salt")


def _sized(pairs: DataFrame) -> DataFrame:
    near = F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb")
    return pairs.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pairs_with_ends(members: DataFrame) -> DataFrame:
    """Each member with the smallest and the largest of its bucket."""
    ends = members.groupBy("key").agg(*(end(F.struct("uid", "n")).alias(end.__name__) for end in (F.min, F.max)))
    ends = ends.select("key", F.explode(F.array("min", "max")).alias("end"))
    joined = _met(members, ends).where(F.col("end.uid") != F.col("uid"))
    return _sized(joined.select(F.col("end.uid").alias("a"), F.col("uid").alias("b"), F.col("end.n").alias("na"), F.col("n").alias("nb")))


def _of_several(listed: DataFrame) -> DataFrame:
    """The rows of ``listed`` whose key another row has too."""
    shared = listed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    return _met(listed, shared)


def _bit_sets(texts: DataFrame) -> DataFrame:
    """uid and bits of texts' words."""

    def run(batches):
        tool = Shingler()
        for batch in batches:
            sets = [tool.bit_set(tool.words(text)).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["uid", "bits"])

    return texts.select("uid", "text").mapInArrow(run, "uid long, bits binary")


def alike(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in a and b, and the share of words in common at most, of pairs that may align.

    Both hold arrays n (words) and bits (one width).  Each matched word has a bit of its
    own in both sets or shares one with words of its text, which are as many as the text
    has words beyond its bits.
    """
    ones = [np.bitwise_count(x["bits"]).sum(1, dtype=np.int64) for x in (a, b)]
    spare_a, spare_b = a["n"] - ones[0], b["n"] - ones[1]
    step = max(1, BLOCK_BYTES // max(1, b["bits"].nbytes))
    found = []
    for at in range(0, len(a["n"]), step):
        part = slice(at, at + step)
        size = np.maximum(a["n"][part, None], b["n"][None, :])
        common = np.bitwise_count(a["bits"][part, None, :] & b["bits"][None, :, :]).sum(2, dtype=np.int64)
        common += np.minimum(spare_a[part, None], spare_b[None, :])
        common = np.minimum(common, np.minimum(a["n"][part, None], b["n"][None, :]))
        i, j = np.nonzero(common >= THRESHOLD * size)
        found.append((i + at, j, common[i, j] / size[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _folded(rows: dict, where: np.ndarray, width: int) -> dict:
    """The rows at ``where`` with sets of ``width`` 64-bit numbers."""
    bits = np.frombuffer(b"".join(rows["bits"][i] for i in where), np.uint64).reshape(len(where), -1)
    if bits.shape[1] > width:
        bits = bits[:, :width] | bits[:, width:]
    return {"n": rows["n"][where], "bits": bits}


def _of_group(rows: dict, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """uids of the pairs of a group that may align and are of two classes.

    Rows of side 1, if any, are only paired with those of side 0.  With ``best``, one
    pair of each two classes.
    """
    uid, comp, side = rows["uid"], rows["comp"], rows["side"]
    width = np.array([len(x) // 8 for x in rows["bits"]])
    two = side.any()
    places = [[], [], []]
    for low in np.unique(width):
        for high in (low, 2 * low):  # sets differ more only where lengths do
            for first, second in {(low, high), (high, low)}:
                one = np.flatnonzero((width == first) & (side == 0))
                other = np.flatnonzero((width == second) & (side == int(two)))
                if not len(one) or not len(other) or (not two and first > second):
                    continue
                i, j, share = alike(_folded(rows, one, low), _folded(rows, other, low))
                i, j = one[i], other[j]
                good = comp[i] != comp[j]
                if not two and first == second:
                    good &= i < j
                for place, x in zip(places, (i, j, share)):
                    place.append(x[good])
    i, j, share = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in places)
    if best and len(i):
        ends = np.sort(np.stack([comp[i], comp[j]]), axis=0)
        order = np.lexsort((uid[j], uid[i], -share, ends[1], ends[0]))
        runs = ends[:, order]
        chosen = order[np.r_[True, (runs[:, 1:] != runs[:, :-1]).any(0)]]
        i, j = i[chosen], j[chosen]
    return np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j])


def _groups(members: DataFrame) -> DataFrame:
    """Members with the groups in which all pairs of a bucket meet, lengths allowing.

    A bucket of up to ``CLASSES`` members is one group.  Members of a larger one are cut
    into blocks by length, and a group is a block, or two of lengths alike.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = stored(sizes.where("low != high").select("key", "size"), "mixed")
    members = _met(members.select("key", "uid", "n", "comp"), mixed)
    small = members.where(F.col("size") <= CLASSES).select(
        "key", "uid", "n", "comp", F.array(F.struct(*(F.lit(0).alias(x) for x in ("len", "i", "upper", "j", "side")))).alias("groups")
    )
    length = F.floor(F.log("n") / F.log(F.lit(LENGTHS))).cast("int")
    large = members.where(F.col("size") > CLASSES).select("key", "uid", "n", "comp", length.alias("len"))
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(CLASSES)), BLOCK_BYTES / (2 * F.pow(F.lit(LENGTHS), F.col("len") + 1))))
    lengths = large.groupBy("key", "len").agg(F.count("*").alias("rows"))
    lengths = stored(lengths.select("key", "len", F.ceil(F.col("rows") / most).cast("int").alias("blocks")), "blocks")
    around = lengths
    for name, by in (("below", 1), ("above", -1)):
        near = lengths.select("key", (F.col("len") + by).alias("len"), F.col("blocks").alias(name))
        around = around.join(near, ["key", "len"], "left")
    around = stored(around.fillna(0), "blocks")
    blocks = F.col("blocks")
    placed = large.withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int")).join(
        around.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "len", "salt"]
    ).withColumn("i", F.pmod(F.xxhash64("uid"), blocks).cast("int"))
    own = F.col("i")

    def up_to(count: str, group) -> F.Column:
        numbers = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda j: F.struct(*(x.cast("int").alias(n) for n, x in zip(("len", "i", "upper", "j", "side"), group(j)))))

    level = F.col("len")
    groups = F.concat(
        up_to("blocks", lambda j: (level, F.least(own, j), level, F.greatest(own, j), (own > j))),
        up_to("above", lambda j: (level, own, level + 1, j, F.lit(0))),
        up_to("below", lambda j: (level - 1, j, level, own, F.lit(1))),
    )
    return small.unionByName(placed.select("key", "uid", "n", "comp", groups.alias("groups")))


def _may_align(members: DataFrame, sets: DataFrame, best: bool) -> DataFrame:
    """The pairs (a, b) of two classes that share a bucket and may align.

    ``members`` has key, uid, n and comp, ``sets`` the bits of their texts.
    """
    listed = _groups(members).join(sets, "uid").select("key", "uid", "n", "comp", "bits", F.explode("groups").alias("group"))
    place = F.xxhash64("key", "group.len", "group.i", "group.upper", "group.j")
    rows = listed.select("key", place.alias("group"), "uid", "n", "comp", F.col("group.side").alias("side"), "bits")

    def run(batches):
        held, now = [], None

        def pairs():
            columns = {n: np.concatenate([x.column(n).to_numpy(zero_copy_only=False) for x in held]) for n in ("uid", "n", "comp", "side", "bits")}
            a, b = _of_group(columns, best)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in ("key", "group")])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]) if batch.num_rows else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                at = tuple(keys[:, start])
                if at != now and held:
                    yield pairs()
                    held = []
                now = at
                held.append(batch.slice(start, end - start))
        if held:
            yield pairs()

    dealt = rows.repartition("key", "group").sortWithinPartitions("key", "group")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (uid, row, class_id, class_size, keeper) and texts (uid, text) of ``docs``.

    ``docs`` needs doc_id and text; ``row`` has its columns but text.  One keeper stays in
    each class: the row of the smallest doc_id, null ids last, ties broken by position;
    its doc_id is the class_id.  Texts of equal words, case aside, are of one class; so
    repeated rows are.  Null texts and texts without words are classes of their own.
    Texts are compared whole; an empty table gives none; columns with clashing names
    stay inside ``row``.
    """
    table = stored(_sketched(spread(docs)), "sketches")
    worded = table.where("fp is not null")
    folded = stored(worded.groupBy("fp").agg(F.min("uid").alias("uid")), "texts")
    texts = table.select("uid", "text")
    distinct = table.select("uid", "n", "bands").join(folded.select("uid"), "uid", "leftsemi")
    listed = distinct.select("uid", "n", F.explode("bands").alias("key"))
    # only buckets of several texts take part in the rounds
    crowded = stored(_of_several(listed), "buckets")
    compared = stored(texts.join(crowded.select("uid").distinct(), "uid", "leftsemi"), "compared")

    tried: DataFrame | None = None
    comps: DataFrame | None = None

    def compare(pairs: DataFrame) -> None:
        nonlocal tried, comps
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "leftanti")
        new = stored(_accepted(pairs, compared), "aligned")
        tried = new if tried is None else tried.unionByName(new)
        if comps is None or new.where("good").limit(1).count():
            comps = merged(comps, new.where("good"))

    compare(_pairs_with_ends(crowded))
    sets = stored(_bit_sets(compared), "bits")
    for best in (True, False):
        members = stored(_with_comp(crowded, comps), "members")
        compare(stored(_may_align(members, sets, best), "pairs"))
    whole = folded.join(comps.withColumnRenamed("node", "uid"), "uid", "left").select(
        "fp", F.coalesce("comp", "uid").alias("class")
    )
    named = table.select("uid", "row", "fp").join(whole, "fp", "left")
    named = stored(named.select("uid", "row", F.coalesce("class", "uid").alias("class")), "classes")
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col("uid"))
    firsts = (
        named.groupBy("class")
        .agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
        .select("class", "class_size", F.col("first.doc_id").alias("class_id"), F.col("first.uid").alias("kept"))
    )
    classes = named.join(firsts, "class").select(
        "uid", "row", "class_id", "class_size", (F.col("uid") == F.col("kept")).alias("keeper")
    )
    return classes, texts


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, all columns unchanged."""
    classes, texts = classified(docs)
    kept = classes.where("keeper").select("uid", "row").join(texts, "uid")
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return kept.select(*columns)
