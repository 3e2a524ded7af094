"""The manifest against a plain recursion over all rows."""

import string
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from parley.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture(scope="module")
def seen(spark):
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return {"text": F.when(chosen, lower).otherwise(F.col("text"))}


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, place):
    path = []
    for nodes in levels[:-1]:
        first = place // 8 * 8
        path.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 8])))
        place //= 8
    return path


def by_recursion(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda name: (name is not None, (name or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[name] = levels_of([leaf(r) for r in trees[name]])
    top = levels_of([built[name][-1][0] for name in names])
    for number, name in enumerate(names):
        for place, row in enumerate(trees[name]):
            path = path_of(built[name], place) + path_of(top, number)
            seen = row
            if row[0] is not None and row[4] and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                seen = (*row[:4], row[4].encode().lower().decode())
            node = leaf(seen)
            for before, after in path:
                node = h(before + node + after)
            root = top[-1][0]
            proof = h("".join(a + b for a, b in path))
            yield row[0], leaf(row), built[name][-1][0], root, proof, node, node == root


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("count,block_levels", [(1, 1), (9, 2), (65, 2), (130, 1)])
def test_manifest_equals_recursion(spark, seen, count, block_levels):
    rows = [
        (i * 7919 % 1000, "web", None if i % 9 == 1 else "xy"[i % 5 == 0], i, f"Text {i} É")
        for i in range(count)
    ]
    docs = spark.createDataFrame(rows, COLUMNS)
    got = merkle.manifest(docs, seen=seen, block_levels=block_levels).collect()
    assert ordered(got) == ordered(by_recursion(rows))


def test_manifest_of_odd_rows(spark, seen, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert ordered(merkle.manifest(odd, seen=seen).collect()) == ordered(by_recursion(rows))
    assert merkle.manifest(none).collect() == []


def test_any_change_is_seen(spark, odd):
    assert all(r.verified for r in merkle.manifest(odd).collect())
    changed = {"n_chars": F.when(F.col("doc_id") == 11, F.lit(-1)).otherwise(F.col("n_chars"))}
    kept = merkle.manifest(odd, seen=changed).where("NOT verified").select("id").distinct().collect()
    assert [r.id for r in kept] == [11]


def test_every_node_of_a_tall_tree_finds_the_root(spark):
    total = 8**3 + 77
    nodes = spark.range(total).select(
        F.lit(5).cast("long").alias("tree"), F.col("id").alias("place"),
        F.lit(total).cast("long").alias("total"), F.sha2(F.col("id").cast("string"), 256).alias("root"),
    )
    levels = levels_of([h(str(i)) for i in range(total)])
    got = {r.place: r for r in merkle.butterfly(nodes).collect()}
    assert sorted(got) == list(range(total))
    for place, row in got.items():
        assert row.root == levels[-1][0]
        assert [tuple(p) for p in row.path] == path_of(levels, place)
