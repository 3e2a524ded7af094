"""Merkle manifest of a dataset, its upper proofs acquired by butterfly exchange.

Every row is a leaf.  The leaves of a tree (a language) are ordered and cut into blocks
of ``fanout ** block_levels``: aligned parts of the tree, each of which one task hashes.
What lies above the blocks is found by a butterfly: in round ``r`` the up to ``fanout``
blocks whose numbers differ in digit ``r`` only form a group and swap the roots of the
subtrees they stand for; each hashes their common parent itself and notes the others as
siblings.  After the last round every block holds the root and its whole upper proof, so
nothing has to travel down the tree again.  Ancestors are hashed once per block below
them, which costs a few digests and saves the downward pass.

Where the last subtree of a round has fewer blocks than the others, its blocks also
answer for the places it lacks, so that every group finds all its roots.  A round thus
sends at most one digest per block and one per place lacking, less than twice the blocks.

The roots of the trees are the leaves of one last tree over the trees, exchanged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import look_up, stored
from parley.operators.numbering import with_rank

FANOUT = 8
#: Levels hashed inside a block: 512 leaves at fanout 8.
BLOCK_LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<before: string, after: string>>"
PROVEN = (
    "id {type}, leaf string, subroot string, root string,"
    " proof_sha256 string, folded_root string, verified boolean"
)


def digest(text: str) -> str:
    """Lowercase hex sha256."""
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in bytes, a colon and the value."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(value.isNull(), F.lit("-")).otherwise(sized)


def leaf(values: list[Column]) -> Column:
    """Digest of the fields of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def levels_of(nodes: list[str], fanout: int, exactly: int | None) -> list[list[str]]:
    """All levels from ``nodes`` upwards: ``exactly`` so many, or until one node remains."""
    levels = [nodes]
    while len(levels[-1]) > 1 if exactly is None else len(levels) <= exactly:
        below = levels[-1]
        levels.append(
            [digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)]
        )
    return levels


def siblings(levels: list[list[str]], place: int, fanout: int) -> Iterator[tuple[str, str]]:
    """Per level the digests before and after a node in its run."""
    for nodes in levels[:-1]:
        first = place // fanout * fanout
        yield "".join(nodes[first:place]), "".join(nodes[place + 1 : first + fanout])
        place //= fanout


def _inside(table: pa.Table, fanout: int, block_levels: int) -> tuple[pa.Table, list[list[str]]]:
    """A block's rows in order and its levels; a tree of one block ends at its root."""
    table = table.sort_by("place")
    whole_tree = table["total"][0].as_py() <= fanout**block_levels
    nodes = [d.hex() for d in table["leaf"].to_pylist()]
    return table, levels_of(nodes, fanout, None if whole_tree else block_levels)


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Roots and paths of trees, every node acquiring its own.

    ``nodes``: ``tree``, ``place`` (0-based, without gaps), ``total`` (nodes of the tree)
    and ``root`` (hex), one row each.  Returned: ``tree``, ``place``, ``root`` of the
    whole tree and ``path``, per level the siblings before and after.  A tree of one node
    is its own root.  No group has more than ``fanout`` rows; there are as many rounds,
    one small shuffle each, as the tallest tree has levels.
    """
    most = nodes.agg(F.max("total")).first()[0] or 0
    nodes = nodes.select(
        "tree", "place", "total", "root", F.array().cast(PATH).alias("path")
    )
    span = 1
    while span < most:
        open_ = F.col("total") > span
        own_lane = F.pmod("place", F.lit(span))
        subtree = F.floor(F.col("place") / span)
        size = F.least(F.lit(span).cast("long"), F.col("total") - subtree * span)
        lanes = F.when(
            open_ & (size < span), F.sequence(own_lane, F.lit(span - 1).cast("long"), size)
        ).otherwise(F.array(own_lane))
        sent = nodes.select(
            "tree", "total", "root", "path", "place", own_lane.alias("own"),
            F.floor(subtree / fanout).alias("parent"),
            F.pmod(subtree, F.lit(fanout)).alias("digit"),
            F.explode(lanes).alias("lane"),
        )
        mine = F.col("own") == F.col("lane")
        member = F.struct(
            "digit", "root", F.when(mine, F.col("place")).alias("place"),
            F.when(mine, F.col("path")).alias("path"),
        )
        met = sent.groupBy("tree", "total", "parent", "lane").agg(
            F.array_sort(F.collect_list(member)).alias("group")
        )
        joined = F.array_join("group.root", "")
        parent = F.when(open_, F.sha2(joined, 256)).otherwise(F.col("group")[0]["root"])
        swapped = met.select(
            "tree", "total", "group", parent.alias("up"), F.explode("group").alias("m")
        ).where("m.place IS NOT NULL")
        pair = F.struct(
            F.expr("array_join(filter(group, g -> g.digit < m.digit).root, '')").alias("before"),
            F.expr("array_join(filter(group, g -> g.digit > m.digit).root, '')").alias("after"),
        )
        path = F.when(open_, F.concat("m.path", F.array(pair))).otherwise(F.col("m.path"))
        nodes = swapped.select(
            "tree", F.col("m.place").alias("place"), "total", F.col("up").alias("root"),
            path.alias("path"),
        )
        span *= fanout
    return nodes.select("tree", "place", "root", "path")


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    tree: str = "lang",
    order: str = "doc_id",
    seen: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Per row its leaf, the roots, the digest of its proof and whether it still fits.

    ``seen`` replaces columns by what is found when verifying; without it the rows
    themselves are folded.  Returned: ``id`` (the ``order`` value), ``leaf``, ``subroot`` (of
    its ``tree``), ``root``, ``proof_sha256`` (the siblings from the leaf's run up to the
    root), ``folded_root`` (from the leaf as seen and the siblings) and ``verified``.

    Nulls in any column have a form of their own; a null tree value is a tree, the first.
    Leaves ascend by ``order``, nulls first, ties by leaf; equal rows are equal leaves, each
    with a proof of its own.  An empty table has an empty manifest.  Other columns, whatever their
    names, are left out.  Texts are hashed whole where they are read, and only digests travel.
    """
    own = [F.col(c) for c in columns]
    found = [(seen or {}).get(c, F.col(c)) for c in columns]
    kind = docs.schema[order].dataType.simpleString()
    leaves = stored(
        docs.select(
            F.col(tree).alias("tree"), F.col(order).alias("id"), leaf(own).alias("leaf"),
            leaf(found).alias("seen"),
        ).withColumn("seen", F.nullif("seen", "leaf")),
        "leaves",
    )
    ranked = with_rank(leaves, "tree", "id", "leaf")
    trees = ranked.groupBy("tree").agg(
        F.count("*").alias("total"), F.min("position").alias("start")
    )
    trees = stored(with_rank(stored(trees, "trees"), "start", name="number"), "trees")
    size = fanout**block_levels
    placed = look_up(ranked, trees, ["tree"], F.col("position"))
    place = F.col("position") - F.col("start")
    placed = placed.select(
        "number", F.floor(place / size).alias("block"), place.alias("place"), "total",
        "id", "leaf", "seen",
    )

    def root_of(table: pa.Table) -> pa.Table:
        table, levels = _inside(table, fanout, block_levels)
        blocks = -(-table["total"][0].as_py() // size)
        row = [table["number"][0].as_py(), table["block"][0].as_py(), blocks, levels[-1][0]]
        return pa.table([[value] for value in row], names=["tree", "place", "total", "root"])

    blocks = placed.groupBy("number", "block").applyInArrow(
        root_of, "tree long, place long, total long, root string"
    )
    blocks = stored(butterfly(stored(blocks, "blocks"), fanout), "blocks")
    roots = blocks.where("place = 0").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"),
        F.lit(trees.count()).cast("long").alias("total"), "root",
    )
    tops = butterfly(roots, fanout).select(
        F.col("place").alias("tree"), F.col("root").alias("top"), F.col("path").alias("top_path")
    )
    paths = look_up(blocks, stored(tops, "tops"), ["tree"], F.col("place")).select(
        F.col("tree").alias("number"), F.col("place").alias("block"),
        F.col("root").alias("subroot"), F.col("top").alias("root"),
        F.concat("path", "top_path").alias("path"),
    )
    schema = PROVEN.format(type=kind)

    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, levels = _inside(rows, fanout, block_levels)
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        upper = [(p["before"], p["after"]) for p in above["path"][0].as_py()]
        proofs, folded = [], []
        for place, seen_leaf in enumerate(rows["seen"].to_pylist()):
            path = [*siblings(levels, place, fanout), *upper]
            proofs.append(digest("".join([part for pair in path for part in pair])))
            node = levels[0][place] if seen_leaf is None else seen_leaf.hex()
            for before, after in path:
                node = digest(before + node + after)
            folded.append(node)
        count = len(folded)
        return pa.table(
            {
                "id": rows["id"],
                "leaf": levels[0],
                "subroot": [subroot] * count,
                "root": [root] * count,
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [node == root for node in folded],
            }
        )

    return (
        placed.groupBy("number", "block")
        .cogroup(paths.groupBy("number", "block"))
        .applyInArrow(prove, schema)
    )

