"""Repetition score of a text.

The score counts two- and three-word sequences that occur again, as substrings,
in the joined words after them.  Because matching is by substring, "a b" also
occurs inside "la bc"; counting word n-grams would be wrong, and a native
higher-order-function form rebuilds the joined tail at every word.  So this one
rule is an Arrow UDF.

Short texts use ``str.find`` on the joined text, which is quadratic but very
quick, for pairs whose characters around the space are met again.  Long texts use an index that is close to linear: a sequence can only
recur where its first word ends some word, its last word begins a later one and
any middle word matches whole, so it is enough to remember the last place of
every such (suffix, prefix) combination.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Below this many words the substring search is the quicker of the two.
LONG_TEXT_WORDS = 4000
# Fewer pairs are all searched for.
FEW_PAIRS = 250
# Characters next to a space that are looked at; their codes are met again if these sums are.
EDGE = 3
PRIMES = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
    np.uint64,
)
# Characters searched in the time of one step of the index.
STEP_COST = 100


def repetition_of(text: str | None) -> float:
    if not text or len(text) < 10:
        return 0.0
    tokens = text.lower().split()
    pairs, triples = max(len(tokens) - 3, 0), max(len(tokens) - 5, 0)
    if not pairs:
        return 0.0
    count = hits_by_search if len(tokens) < LONG_TEXT_WORDS else hits_by_index
    pair_hits, triple_hits = count(tokens, pairs, triples)
    return min(1.0, (pair_hits + 2 * triple_hits) / (pairs + triples))


def met_again(joined: str, pairs: int) -> list[int]:
    """Places of pairs whose characters around the space come again two words later or more.

    No other pair can recur.  Of words of ``EDGE`` characters and more these are the
    ``EDGE`` next to the space, of shorter ones the one.
    """
    pad = " " * EDGE
    codes = np.frombuffer(f"{pad}{joined}{pad}".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    spaces = np.flatnonzero(codes == 32)[EDGE:-EDGE]
    long = np.diff(np.r_[EDGE - 1, spaces, len(codes) - EDGE]) > EDGE
    around = codes[spaces - 1] * PRIMES[0] + codes[spaces + 1] * PRIMES[1]
    before = codes[spaces - 2] * PRIMES[2] + codes[spaces - 3] * PRIMES[3]
    after = codes[spaces + 2] * PRIMES[4] + codes[spaces + 3] * PRIMES[5]
    left, right = long[:pairs], long[1 : pairs + 1]
    found = []
    for key, places in (
        (around + before + after, left & right),
        (around + before, left & ~right),
        (around + after, ~left & right),
        (around, ~left & ~right),
    ):
        places = np.flatnonzero(places)
        if len(places):
            order = np.argsort(key, kind="stable")
            last = order[np.searchsorted(key[order], key[places], side="right") - 1]
            found.append(places[last >= places + 2])
    return np.sort(np.concatenate(found)).tolist()


def hits_by_search(tokens: list[str], pairs: int, triples: int) -> tuple[int, int]:
    joined = " ".join(tokens)
    begin = list(accumulate((len(token) + 1 for token in tokens), initial=0))
    pair_hits = triple_hits = 0
    for i in met_again(joined, pairs) if pairs >= FEW_PAIRS else range(pairs):
        # A triple can only recur at or after a place where its leading pair does.
        place = joined.find(joined[begin[i] : begin[i + 2] - 1], begin[i + 2])
        if place < 0:
            continue
        pair_hits += 1
        if i < triples:
            triple = joined[begin[i] : begin[i + 3] - 1]
            triple_hits += joined.find(triple, max(place, begin[i + 3])) >= 0
    return pair_hits, triple_hits


def hits_by_index(tokens: list[str], pairs: int, triples: int) -> tuple[int, int]:
    vocabulary = {token: number for number, token in enumerate(dict.fromkeys(tokens))}
    lengths = sorted({len(token) for token in vocabulary})
    tails: list[list[int]] = []
    heads: list[list[int]] = []
    for token in vocabulary:
        size = len(token)
        own_tails, own_heads = [], []
        for length in lengths:
            if length > size:
                break
            tail = vocabulary.get(token[size - length :])
            if tail is not None:
                own_tails.append(tail)
            start = vocabulary.get(token[:length])
            if start is not None:
                own_heads.append(start)
        tails.append(own_tails)
        heads.append(own_heads)

    ids = [vocabulary[token] for token in tokens]
    count, width = len(ids), len(vocabulary)
    # Words made of each other make the index dense; then the search is the quicker.
    steps = sum(
        len(tails[a]) * (len(heads[b]) + len(heads[c]))
        for a, b, c in zip(ids, ids[1:], [*ids[2:], ids[-1]])
    )
    if steps * STEP_COST > pairs * sum(map(len, tokens)):
        return hits_by_search(tokens, pairs, triples)
    # Only sequences that are looked up later need a place.
    last_pair = {ids[i] * width + ids[i + 1]: -1 for i in range(pairs)}
    last_triple = {
        (ids[i] * width + ids[i + 1]) * width + ids[i + 2]: -1 for i in range(triples)
    }
    for j in range(count - 1):
        following = heads[ids[j + 1]]
        for tail in tails[ids[j]]:
            base = tail * width
            for start in following:
                if base + start in last_pair:
                    last_pair[base + start] = j
    for j in range(count - 2):
        following = heads[ids[j + 2]]
        middle = ids[j + 1]
        for tail in tails[ids[j]]:
            base = (tail * width + middle) * width
            for start in following:
                if base + start in last_triple:
                    last_triple[base + start] = j
    pair_hits = sum(last_pair[ids[i] * width + ids[i + 1]] >= i + 2 for i in range(pairs))
    triple_hits = sum(
        last_triple[(ids[i] * width + ids[i + 1]) * width + ids[i + 2]] >= i + 3
        for i in range(triples)
    )
    return pair_hits, triple_hits


@F.pandas_udf(DoubleType())
def _scores(texts: pd.Series) -> pd.Series:
    return pd.Series([repetition_of(text) for text in texts], dtype="float64")


def repetition_score(text: Column) -> Column:
    """Text that is no UTF-8 cannot enter Python and scores 0, as a null does."""
    return _scores(F.when(F.is_valid_utf8(text), text))
