"""Grouping spelling variants by composing finite-state machines.

Near words are what a composition accepts: the minimised acceptor of the vocabulary, a
transducer of exactly one edit (an inserted, deleted or replaced character), and the
acceptor again.  Before the edit both acceptors read the same characters and stand in the
same state; after it they walk together through the states of the two words, until both accept.

The composition is cut into parts by its first states.  Words that agree in their first
``head`` characters share a state of the acceptor, and pairs edited behind it are found
in the part of that state.  Pairs edited earlier agree in their last characters, and are
found in the same way in the parts of the mirrored vocabulary.  The first difference
decides which, so every pair is found once.

One task builds the acceptors of its parts, one after the other, each of at most
``PART_WORDS`` words.  A state with more words is left by one character: pairs edited in this
very step have the same rest and meet on it, and all others are in the parts of the
states after it, until all fit.  Nothing is capped, and no task sees more than a part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import look_up, stored

LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 7, 2
#: A form must be so many times as frequent as its variant.
RATIO = 10
#: Words of a part, built into one acceptor of some tens of MB.
PART_WORDS = 20_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000

PAIRS = "a string, a_n long, b string, b_n long"


def occurrences(doc_id, text: str | None, runs, drop_one_in: int | None) -> Counter:
    """Words of a text: runs with A-Z in lower case, some of them with a letter lost.

    With ``drop_one_in`` a run loses the character that the crc32 of ``<doc_id>:<run>``
    names, where that number is a multiple; a null id is written as nothing.
    """
    found = Counter(runs((text or "").encode().lower().decode()))
    if drop_one_in is None:
        return found
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), before)
        if h % drop_one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    letters: str = LETTERS,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    drop_one_in: int | None = None,
) -> DataFrame:
    """(word, n): distinct words of the texts and how often they occur.

    Counted in the tasks that read the texts, whole texts each, and then added up by word.
    """
    pattern = rf"[{letters}]{{{min_length},}}"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(pattern).findall
        total: Counter = Counter()
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update(occurrences(doc_id, value, runs, drop_one_in))
                if len(total) >= COUNTED:
                    yield counted(total)
                    total.clear()
        yield counted(total)

    def counted(total: Counter) -> pa.RecordBatch:
        words = [w for w in total if len(w) >= min_length]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"]
        )

    counts = docs.select(key, text).mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Acceptor:
    """Minimal deterministic acceptor of sorted distinct words.

    States are numbered; equal states (same acceptance, same moves) are one.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.moves: list[dict[str, int]] = []
        register: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]
        before = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                accepts, moves = path.pop()
                form = accepts, tuple(moves.items())
                state = register.setdefault(form, len(self.final))
                if state == len(self.final):
                    self.final.append(accepts)
                    self.moves.append(moves)
                path[-1][1][before[len(path) - 1]] = state

        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            close(shared)
            path += [[False, {}] for _ in word[shared:]]
            path[-1][0] = True
            before = word
        close(0)
        self.start = len(self.final)
        self.final.append(path[0][0])
        self.moves.append(path[0][1])

    def one_edit_pairs(self) -> Iterator[tuple[str, str]]:
        """Pairs accepted by acceptor, one-edit transducer and acceptor, each once.

        A pair is found where the words part: both go on with different letters and then
        alike, or the first has one more letter there.
        """
        both: dict[tuple[int, int], list[str]] = {}
        todo = [("", self.start)]
        while todo:
            prefix, state = todo.pop()
            walked = []
            while len(self.moves[state]) == 1 and not self.final[state]:
                ((letter, state),) = self.moves[state].items()
                walked.append(letter)
            prefix += "".join(walked)
            moves = self.moves[state]
            options = list(moves.items())
            for i, (a, after_a) in enumerate(options):
                for b, after_b in options[i + 1 :]:
                    for rest in self._both(after_a, after_b, both):
                        yield prefix + a + rest, prefix + b + rest
                if self.final[state] and self.final[after_a]:
                    yield prefix + a, prefix
                # A rest that starts with the same letter is found one step later.
                for b, after_b in options:
                    again = self.moves[after_a].get(b) if b != a else None
                    if again is not None:
                        for rest in self._both(again, after_b, both):
                            yield prefix + a + b + rest, prefix + b + rest
                todo.append((prefix + a, after_a))

    def _both(self, s: int, t: int, known: dict[tuple[int, int], list[str]]) -> list[str]:
        """What both states accept: the machine after its edit."""
        first = (s, t) if s < t else (t, s)
        todo = [first]
        while todo:
            pair = todo[-1]
            if pair in known:
                todo.pop()
                continue
            (s, t), walked = pair, []
            while True:
                over, under = self.moves[s], self.moves[t]
                shared = [c for c in over if c in under]
                accepts = self.final[s] and self.final[t]
                if accepts or len(shared) != 1:
                    break
                walked.append(shared[0])
                s, t = over[shared[0]], under[shared[0]]
            after = [(c, min(over[c], under[c]), max(over[c], under[c])) for c in shared]
            missing = [(x, y) for _, x, y in after if (x, y) not in known]
            if missing:
                todo += missing
                continue
            rests = [""] if accepts else []
            rests += [c + rest for c, x, y in after for rest in known[x, y]]
            start = "".join(walked)
            known[pair] = [start + rest for rest in rests] if start else rests
            todo.pop()
        return known[first]


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, int]]]:
    """Runs of rows with the same part; rows come sorted by it and by word."""
    part, words = None, {}
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("way", "part", "word", "n")]
        for way, key, word, n in zip(*columns):
            if (way, key) != part:
                if part is not None:
                    yield part, words
                part, words = (way, key), {}
            words[word] = n
    if part is not None:
        yield part, words


def _pairs(found: Iterable[tuple[int, str, int, str, int]], head: int) -> Iterator[pa.RecordBatch]:
    """Batches of pairs, mirrored ones turned round and kept if they part before ``head``."""
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        types = (pa.string(), pa.int64()) * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["a", "a_n", "b", "b_n"])

    for way, a, a_n, b, b_n in found:
        if way:
            a, b = a[::-1], b[::-1]
            if a[:head] == b[:head]:
                continue
        rows.append((a, a_n, b, b_n))
        if len(rows) >= 10_000:
            yield batch()
            rows = []
    yield batch()


def near_pairs(
    words: DataFrame, min_length: int = MIN_LENGTH, part_words: int = PART_WORDS
) -> DataFrame:
    """Each pair of words at exactly one edit, once: ``a``, ``a_n``, ``b``, ``b_n``.

    ``words`` (distinct ``word``, ``n``) must be cheap to read (stored).
    """
    head = (min_length + 1) // 2
    ways = F.expr(
        f"""explode(array(named_struct('way', 0, 'depth', {head}, 'word', word),
        named_struct('way', 1, 'depth', {min_length - head}, 'word', reverse(word))))"""
    )
    open_ = words.select("n", ways.alias("w")).select("w.way", "w.depth", "w.word", "n")
    open_ = open_.withColumn("part", F.expr("left(word, depth)"))

    def compose(batches):
        def found():
            for (way, key), group in _groups(batches):
                if len(group) > 1:
                    rests = sorted(word[len(key) :] for word in group)
                    for a, b in Acceptor(rests).one_edit_pairs():
                        yield way, key + a, group[key + a], key + b, group[key + b]

        return _pairs(found(), head)

    def step(batches):
        def found():
            for batch in batches:
                for way, rest, met in zip(*(batch.column(n).to_pylist() for n in ("way", "rest", "met"))):
                    for i, a in enumerate(met):
                        for b in met[i + 1 :]:
                            # Two lost letters differ; a lost letter and none: the rest starts otherwise.
                            lost = a["lost"] or b["lost"]
                            if (a["lost"] and b["lost"]) or not rest.startswith(lost):
                                yield way, a["word"], a["n"], b["word"], b["n"]

        return _pairs(found(), head)

    fitting, stepped = [], []
    while True:
        large = open_.groupBy("way", "part").agg(F.count("*").alias("size"))
        large = stored(large.where(F.col("size") > part_words).withColumn("is_large", F.lit(True)), "parts")
        if large.isEmpty():
            fitting.append(open_)
            break
        marked = look_up(open_, large.drop("size"), ["way", "part"], F.col("word"))
        marked = stored(marked, "states")
        fitting.append(marked.where("is_large IS NULL").drop("is_large"))
        over = marked.where("is_large").drop("is_large")
        longer = F.expr("length(word) > depth")
        both = F.expr(
            """array(
            named_struct('rest', substr(word, depth + 1), 'lost', ''),
            named_struct('rest', substr(word, depth + 2), 'lost', substr(word, depth + 1, 1)))"""
        )
        both = F.when(longer, both).otherwise(F.slice(both, 1, 1))
        met = over.select("way", "part", "word", "n", F.explode(both).alias("r")).groupBy(
            "way", "part", F.col("r.rest").alias("rest")
        )
        # At most one word for each letter of the alphabet, and one without.
        met = met.agg(F.collect_list(F.struct("r.lost", "word", "n")).alias("met"))
        stepped.append(met.where(F.size("met") > 1).drop("part").mapInArrow(step, PAIRS))
        over = over.where(longer).withColumn("depth", F.col("depth") + 1)
        open_ = over.withColumn("part", F.expr("left(word, depth)"))
    parts = fitting[0]
    for more in fitting[1:]:
        parts = parts.unionByName(more)
    pairs = (
        parts.select("way", "part", "word", "n")
        .repartition("way", "part")
        .sortWithinPartitions("way", "part", "word")
        .mapInArrow(compose, PAIRS)
    )
    for more in stepped:
        pairs = pairs.unionByName(more)
    return pairs


def grouped(
    words: DataFrame,
    min_length: int = MIN_LENGTH,
    ratio: int = RATIO,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """Every word with its near words' number, its form and the last form of the chain.

    ``words``: ``word``, ``n`` of :func:`vocabulary`, of at least ``min_length`` characters each.
    Returned: ``word``, ``n``, ``n_near``, ``form`` (the near word of largest n, the smallest of
    ties, if at least ``ratio`` times as frequent), ``form_n`` and ``root``.

    Forms grow by ``ratio``, so chains are as long as n has digits; they are followed by doubling.
    Null and empty texts have no words, repeated documents count as often as they occur, an
    empty table gives no rows, and other columns, whatever their names, play no part.
    Words of any length are composed whole.
    """
    words = stored(words.select("word", "n"), "words")
    sides = F.expr(
        """inline(array(named_struct('word', a, 'n', a_n, 'near', b, 'near_n', b_n),
        named_struct('word', b, 'n', b_n, 'near', a, 'near_n', a_n)))"""
    )
    pairs = near_pairs(words, min_length, part_words)
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    near = pairs.select(sides).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near.withColumnRenamed("word", "near_word"), F.col("word") == F.col("near_word"), "left")
    frequent = -F.col("best.rank") >= ratio * F.col("n")
    judged = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, F.col("best.near")).alias("form"),
            F.when(frequent, -F.col("best.rank")).alias("form_n"),
        ),
        "forms",
    )
    most = judged.agg(F.max("form_n")).first()[0] or 1
    steps = stored(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    followed, length = 1, len(str(most))
    while followed < length:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        ahead = look_up(steps, ahead, ["root"], F.col("word"))
        steps = stored(ahead.select("word", F.coalesce("ahead", "root").alias("root")), "roots")
        followed *= 2
    roots = steps.select(F.col("word").alias("variant"), "root")
    return judged.join(roots, F.col("word") == F.col("variant"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
