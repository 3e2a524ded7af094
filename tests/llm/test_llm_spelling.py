"""Variants against a direct definition: every word compared through all its deletions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from parley.llm import spelling
from parley.llm.queries import QUERIES

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def words_of(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def by_definition(words):
    near, gaps = defaultdict(set), defaultdict(set)
    for word in words:
        for i in range(len(word)):
            gaps[word[:i], word[i + 1 :]].add(word)
            shorter = word[:i] + word[i + 1 :]
            if shorter in words:
                near[word].add(shorter)
                near[shorter].add(word)
    for alike in gaps.values():
        for word in alike:
            near[word] |= alike - {word}
    form = {}
    for word, n in words.items():
        best = min(near[word], key=lambda v: (-words[v], v), default=None)
        form[word] = best if best and words[best] >= 10 * n else None
    for word, n in words.items():
        root = word
        while form[root]:
            root = form[root]
        yield word, form[word], root, n, len(near[word]), words.get(form[word])


def rows_of(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Words of two letters and of runs, all near many others, in common parts."""
    rng = random.Random(9)
    words = {}
    for _ in range(400):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(7, 9)))
        words[word] = rng.choice([2, 3, 20, 21, 250, 3000])
    words |= {"a" * n: n for n in range(7, 30)} | {"é" * 7: 5, "é" * 6 + "ÿ": 50, "a" * 9_000: 2}
    words |= {"ab" * 4_000: 2, "ab" * 3_999 + "b": 2, "ab" * 3_999 + "cb": 30}
    folder = str(tmp_path_factory.mktemp("words"))
    spark.createDataFrame(list(words.items()), "word string, n long").write.parquet(f"{folder}/w")
    return words, spark.read.parquet(f"{folder}/w")


@pytest.mark.parametrize("part_words", [20_000, 25])
def test_variants_of_crowded_words(crowded, part_words):
    words, frame = crowded
    short = {w: n for w, n in words.items() if len(w) < 100}
    got = [r for r in rows_of(spelling.grouped(frame, part_words=part_words)) if len(r[0]) < 100]
    assert got == sorted(by_definition(short))


def test_variants_of_very_long_words(crowded):
    _, frame = crowded
    rows = {r[0]: r for r in rows_of(spelling.grouped(frame)) if len(r[0]) >= 100}
    base, lost, other = "ab" * 4_000, "ab" * 3_999 + "b", "ab" * 3_999 + "cb"
    assert rows[base][1] == rows[lost][1] == other and rows[other][4] == 2
    assert rows["a" * 9_000][1:] == (None, "a" * 9_000, 2, 0, None)


def test_pairs_come_once(crowded):
    _, frame = crowded
    for part_words in (20_000, 25):
        pairs = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(frame, part_words=part_words).collect()]
        assert len(pairs) == len(set(pairs))


def test_acceptor_is_minimal():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(120)})
    machine = spelling.Acceptor(words)
    languages = []
    for state in range(len(machine.final)):
        todo, accepted = [("", state)], []
        while todo:
            text, at = todo.pop()
            accepted += [text] * machine.final[at]
            todo += [(text + c, after) for c, after in machine.moves[at].items()]
        languages.append(frozenset(accepted))
    assert sorted(languages[machine.start]) == words
    assert len(set(languages)) == len(languages)


def test_forms_are_followed_to_the_last(spark, tmp_path):
    chain = [("abcdefg" + "x" * i, 2 * 10 ** i) for i in range(9)]
    spark.createDataFrame(chain, "word string, n long").write.parquet(f"{tmp_path}/w")
    rows = rows_of(spelling.grouped(spark.read.parquet(f"{tmp_path}/w")))
    assert {r[2] for r in rows} == {chain[-1][0]}


def test_variants_of_odd_rows(odd, none):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = rows_of(spelling.grouped(spelling.vocabulary(odd, drop_one_in=31)))
    assert got == sorted(by_definition(words_of(docs)))
    assert rows_of(spelling.grouped(spelling.vocabulary(none))) == []


def test_query_equals_definition(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_spelling"](spark, tables)) == sorted(by_definition(words_of(docs)))
