"""Toxicity scores from a fuzzy lexicon and the context of its hits.

The lexicon is learned from labelled rows: words and word beginnings whose share among
toxic documents is many times that among the others.  It is kept as a trie.  A word is
read by the product of the trie with a Levenshtein automaton, made deterministic as far
as words need it, so misspelled terms are caught in one step per letter.  The window
around each hit tells quotation and reporting from direct abuse; a logistic model over
these context scores gives the probability.

Only the lexicon (``LEXICON`` terms at most) and the coefficients go to the workers.
Fitting uses a bounded sample of ``TRAIN_ROWS`` labelled rows; every document is scored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parley.llm.common import stored
from parley.session import spread

#: Labelled rows used for fitting, chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Terms of the lexicon at most, best first.
LEXICON = 3_000
#: A term's share among toxic rows is at least so many times its share among others.
LEAST_RATIO = 35.0
STEMS = range(4, 11)
#: Words on either side of a hit that make its context.
WINDOW = 8

#: Marks and words of quotation and reporting, and of direct address.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset(
    "said says wrote writes called calls quoted quote word term insult reported reports"
    " sagte sagt schrieb nannte zitat wort dit disait écrit appelé mot citation"
    " dijo dice escribió llamó palabra cita".split()
)
ADDRESS = frozenset("you your youre ur u du dich dir ihr tu toi te vous tú ti usted".split())

_words = re.compile(r"\w+").finditer
_bare = re.compile(r"\w+").findall


def edits_allowed(term: str, stem: bool) -> int:
    """Edits within which a word still counts as the term."""
    if len(term) < (6 if stem else 5):
        return 0
    return 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """Trie of terms intersected with Levenshtein automata, determinised when needed.

    A state is the set of (trie node, edits so far) still alive; terms ending in ``*``
    are stems, which match every word that begins with them.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.slack: list[int] = [0]
        self.limits = []
        for number, term in enumerate(terms):
            stem = term.endswith("*")
            letters = term.rstrip("*")
            limit = edits_allowed(letters, stem)
            self.limits.append(limit)
            node = 0
            self.slack[0] = max(self.slack[0], limit)
            for letter in letters:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.slack.append(0)
                node = self.children[node][letter]
                self.slack[node] = max(self.slack[node], limit)
            (self.stem if stem else self.word)[node] = number
        self._forget()

    def _forget(self) -> None:
        start = self._close({0: 0})
        self._ids = {start: 0}
        self._states = [start]
        self._next: list[dict[str, int]] = [{}]
        self._ends: list[tuple | None] = [self._end(start)]
        self._stems: list[tuple | None] = [None]
        self._words: dict[str, tuple | None] = {}

    def _close(self, alive: dict[int, int]) -> frozenset:
        """Add nodes reached by letters that the word leaves out."""
        todo = list(alive)
        while todo:
            node = todo.pop()
            edits = alive[node] + 1
            for child in self.children[node].values():
                if edits <= self.slack[child] and edits < alive.get(child, 99):
                    alive[child] = edits
                    todo.append(child)
        return frozenset(alive.items())

    def _end(self, state: frozenset) -> tuple | None:
        hits = [(e, self.word[n]) for n, e in state if self.word[n] >= 0]
        return min((h for h in hits if h[0] <= self.limits[h[1]]), default=None)

    def _step(self, at: int, letter: str) -> int:
        alive: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.slack[node] and edits < alive.get(node, 99):
                alive[node] = edits

        for node, edits in self._states[at]:
            reach(node, edits + 1)
            for own, child in self.children[node].items():
                reach(child, edits + (own != letter))
        state = self._close(alive)
        if state not in self._ids:
            self._ids[state] = len(self._states)
            self._states.append(state)
            self._next.append({})
            self._ends.append(self._end(state))
            stems = [(e, self.stem[n]) for n, e in state if self.stem[n] >= 0]
            self._stems.append(min((h for h in stems if h[0] <= self.limits[h[1]]), default=None))
        self._next[at][letter] = self._ids[state]
        return self._ids[state]

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term, or None."""
        known = self._words.get(word, 0)
        if known != 0:
            return known
        if len(self._words) > 500_000 or len(self._states) > 100_000:
            self._forget()
        at, best = 0, None
        for letter in word:
            step = self._next[at].get(letter)
            at = self._step(at, letter) if step is None else step
            if self._stems[at] and (best is None or self._stems[at] < best):
                best = self._stems[at]
            if not self._states[at]:
                break
        else:
            if self._ends[at] and (best is None or self._ends[at] < best):
                best = self._ends[at]
        self._words[word] = best
        return best


@dataclass
class Hit:
    term: int
    edits: int
    quoted: bool
    addressed: bool


def hits_in(text: str, lexicon: FuzzyLexicon) -> tuple[int, list[Hit]]:
    """Words of a text and its hits, each with what its window says."""
    lowered = text.lower()
    words = _bare(lowered)
    find = lexicon.find
    at = [i for i, word in enumerate(words) if find(word)]
    if not at:
        return len(words), []
    spans = [m.span() for m in _words(lowered)]
    marks = [i for i, c in enumerate(lowered) if c in QUOTES]
    breaks = [-1, *(i for i, c in enumerate(lowered) if c == "\n")]
    hits = []
    for i in at:
        edits, term = find(words[i])
        near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        # The window with the marks around it.
        first = spans[i - WINDOW - 1][1] if i > WINDOW else 0
        last = spans[i + WINDOW + 1][0] if i + WINDOW + 1 < len(words) else len(lowered)
        before = bisect_right(marks, spans[i][0])
        # Marks open and close in turn within a line: an odd number before leaves one open.
        line = breaks[bisect_left(breaks, spans[i][0]) - 1]
        opened = (before - bisect_left(marks, line)) % 2 == 1
        inside = (
            opened and before < len(marks) and marks[before - 1] >= first and marks[before] <= last
        )
        reported = not REPORTING.isdisjoint(near)
        hits.append(Hit(term, edits, inside or reported, not ADDRESS.isdisjoint(near)))
    return len(words), hits


FEATURES = 9
#: Log odds below which a hit tells nothing.
TELLING = 1.5


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    exact: np.ndarray = field(default_factory=lambda: np.zeros(0))
    fuzzy: np.ndarray = field(default_factory=lambda: np.zeros(0))
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))

    def features(self, n_words: int, hits: list[Hit]) -> np.ndarray:
        def weight(h: Hit) -> float:
            return float((self.fuzzy if h.edits else self.exact)[h.term])

        hits = [h for h in hits if weight(h) >= TELLING]
        direct = [h for h in hits if not h.quoted]
        quoted = [h for h in hits if h.quoted]
        by_term: dict[int, float] = {}
        for h in direct:
            by_term[h.term] = max(weight(h), by_term.get(h.term, 0.0))
        return np.array(
            [
                1.0,
                max(map(weight, direct), default=0.0),
                np.log1p(len(direct)),
                max(map(weight, quoted), default=0.0),
                np.log1p(len(quoted)),
                float(any(h.addressed for h in direct)),
                float(bool(hits) and all(h.edits for h in hits)),
                np.log1p(100 * len(hits) / max(n_words, 1)),
                min(sum(by_term.values()) / 5, 6.0),
            ]
        )

    def probability(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(features @ self.coefficients, -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms_of(text: str | None) -> set[str]:
    """Words and stems a document could lend the lexicon."""
    found = set()
    for word in set(_bare((text or "").lower())):
        if 3 <= len(word) <= 30 and not word.isdigit():
            found.add(word)
            found.update(word[:n] + "*" for n in STEMS if n < len(word))
    return found


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of at most ``rows`` labelled rows outside the held-out fifth."""
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("text").agg(F.max("toxic").alias("toxic"))


def _term_counts(train: DataFrame) -> DataFrame:
    def count(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in terms_of(text):
                    counts.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([c[0] for c in counts.values()], pa.int64()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                ],
                ["term", "clean", "toxic"],
            )

    counted = train.select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long")
    return counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 40) -> np.ndarray:
    """Coefficients by Newton steps; the constant is hardly penalised."""
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - penalty * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and coefficients; without labelled rows of both kinds, the prior alone."""
    train = stored(sample(docs, labels, rows), "toxic-train")
    counts = dict(train.groupBy("toxic").count().collect())
    clean, toxic = counts.get(0, 0), counts.get(1, 0)
    if not clean or not toxic:
        return Model(coefficients=np.array([4.0 if toxic else -4.0] + [0.0] * (FEATURES - 1)))
    train = spread(train)
    share = (F.col("toxic") / toxic) / ((F.col("clean") + 1) / (clean + 1))
    picked = (
        _term_counts(train)
        .where((F.col("toxic") >= max(3, round(0.004 * toxic))) & (share >= min(LEAST_RATIO, 0.3 * clean)))
        .orderBy(F.desc(F.col("toxic") * F.ln(share)), "term")
        .limit(LEXICON)
        .collect()
    )
    terms = [r["term"] for r in picked]
    model = Model(terms)

    def weights(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))

    t, c = (np.array([r[k] for r in picked], float) for k in ("toxic", "clean"))
    model.exact = np.maximum(weights(t, c), 0)

    def nearby(batches):
        """How many texts of each label have a misspelling of a term."""
        lexicon = FuzzyLexicon(terms)
        for batch in batches:
            seen = np.zeros((len(terms), 2), np.int64)
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in {h.term for h in hits_in(text, lexicon)[1] if h.edits}:
                    seen[term, label] += 1
            at, label = np.nonzero(seen)
            columns = [pa.array(at, pa.int32()), pa.array(label, pa.int32()), pa.array(seen[at, label], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "label", "texts"])

    def look(batches):
        """The features of each text, from all its hits."""
        lexicon = FuzzyLexicon(terms)
        for batch in batches:
            found = [model.features(*hits_in(text, lexicon)) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([list(f) for f in found], pa.list_(pa.float64()))], ["label", "features"]
            )

    labelled = train.select("text", F.col("toxic").cast("int").alias("label"))
    near = np.zeros((len(terms), 2))
    counted = labelled.mapInArrow(nearby, "term int, label int, texts long").groupBy("term", "label")
    for row in counted.agg(F.sum("texts").alias("texts")).collect():  # two numbers per term
        near[row["term"], row["label"]] = row["texts"]
    model.fuzzy = np.maximum(np.minimum(weights(near[:, 1], near[:, 0]), model.exact), 0)
    unseen = near.sum(axis=1) == 0
    model.fuzzy[unseen] = model.exact[unseen] / 2
    # One short vector per row of the bounded sample.
    seen = labelled.mapInArrow(look, "label int, features array<double>").collect()
    x = np.array([row["features"] for row in seen])
    model.coefficients = _logistic(x, np.array([row["label"] for row in seen], float))
    return model


def scored(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Struct ``row`` of the carried columns (all by default) and ``score``, 0 to 1.

    Null and empty texts have no hits and score what the model gives a text without
    hits.  Texts are read whole; repeated rows are scored alike; an empty table gives
    none; columns with clashing names stay inside ``row``.
    """
    inner = docs.select(F.struct(*(carry or docs.columns)).alias("row"), "text")
    schema = StructType([inner.schema.fields[0], StructField("score", DoubleType())])

    def run(batches):
        lexicon = FuzzyLexicon(model.terms)
        for batch in batches:
            scores = [
                model.probability(model.features(*hits_in(text or "", lexicon)))
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema.names)

    return inner.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged."""
    model = fit(docs, labels)
    return scored(spread(docs), model).where(F.col("score") < threshold).select("row.*")
