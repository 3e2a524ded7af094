"""Dense positions over an ordered dataset, without a global sort.

A global ``row_number`` would pull every row through one task.  Here rows are
grouped by the high bits of their order key, groups are counted, and the counts
are summed level by level, 16 bits at a time, so that no window group at any
level exceeds 65,536 rows whatever the key distribution.  Everything depends on
key values alone, so lost executors recompute the same positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import work_folder

LEVEL_BITS = 16
# Offsets of with_rank are broadcast up to this many partitions (some 2 MB), else joined.
BROADCAST_PARTS = 100_000
# monotonically_increasing_id keeps the row's place within its partition in the lower bits.
PLACE_BITS = 33
# Slices up to this many rows have their key groups broadcast: every group holds
# at least one row of the slice, so there are never more groups than rows plus two.
BROADCAST_SLICE = 100_000


def _group_offsets(df: DataFrame, key: str, weight: F.Column | None = None) -> DataFrame:
    """(group, rows, before): rows per key group and rows in all earlier groups.

    With ``weight`` a row stands for so many rows.
    """
    rows = F.count("*") if weight is None else F.sum(weight)
    levels = [df.groupBy(F.shiftright(key, LEVEL_BITS).alias("g1")).agg(rows.alias("n1"))]
    for level in (2, 3):
        below = levels[-1]
        levels.append(
            below.groupBy(F.shiftright(f"g{level - 1}", LEVEL_BITS).alias(f"g{level}")).agg(
                F.sum(f"n{level - 1}").alias(f"n{level}")
            )
        )

    def running(level: int, window) -> F.Column:
        return F.sum(f"n{level}").over(window.rowsBetween(Window.unboundedPreceding, -1))

    # The top level holds the 16 highest bits: at most 65,536 rows.
    offsets = levels[2].select(
        "g3", F.coalesce(running(3, Window.orderBy("g3")), F.lit(0)).alias("before")
    )
    for level in (2, 1):
        upper = f"g{level + 1}"
        group = f"g{level}"
        window = Window.partitionBy(upper).orderBy(group)
        inside = levels[level - 1].withColumn(upper, F.shiftright(group, LEVEL_BITS))
        inside = inside.withColumn("inside", F.coalesce(running(level, window), F.lit(0)))
        offsets = inside.join(offsets, upper).select(
            group, f"n{level}", (F.col("before") + F.col("inside")).alias("before")
        )
    return offsets.select(
        F.col("g1").alias("group"), F.col("n1").alias("rows"), F.col("before")
    )


def with_position_by(df: DataFrame, group: str, inner: str, inner_bits: int = 12) -> DataFrame:
    """Add the 0-based ``position`` of each row in (``group``, ``inner``) order.

    For keys that do not fit one long, such as hashed conversation ids with their
    turns: any longs, negative ones included, each pair of them once.  Windows hold
    blocks of a group's rows, or one narrow row per block or group.
    """
    block = F.shiftright(inner, inner_bits)
    blocks = df.groupBy(group, block.alias("_block")).agg(F.count("*").alias("_rows"))
    in_group = Window.partitionBy(group).orderBy("_block")
    groups = blocks.groupBy(group).agg(F.sum("_rows").alias("_rows"))
    upper = _group_offsets(groups, group, F.col("_rows")).select("group", F.col("before").alias("_far"))
    near = Window.partitionBy("group").orderBy(group)

    def earlier(window) -> F.Column:
        return F.coalesce(F.sum("_rows").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    starts = (
        groups.withColumn("group", F.shiftright(group, LEVEL_BITS))
        .withColumn("_near", earlier(near))
        .join(upper, "group")
        .select(group, (F.col("_far") + F.col("_near")).alias("_start"))
    )
    places = blocks.withColumn("_inside", earlier(in_group)).join(starts, group)
    places = places.select(group, "_block", (F.col("_start") + F.col("_inside")).alias("_before"))
    order = Window.partitionBy(group, "_block").orderBy(inner)
    placed = df.withColumn("_block", block).join(places, [group, "_block"])
    position = F.col("_before") + F.row_number().over(order) - 1
    return placed.select(*[placed[c] for c in df.columns], position.alias("position"))


def with_position(
    df: DataFrame, key: str = "row_id", start: int | None = None, size: int | None = None
) -> DataFrame:
    """Add the 0-based ``position`` of each row in ``key`` order (unique longs).

    With ``start`` and ``size`` only that slice is kept, and only the key groups
    overlapping it take part in the window.
    """
    offsets = _group_offsets(df, key)
    if start is not None:
        overlaps = (F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)
        offsets = offsets.where(overlaps)
    offsets = offsets.select("group", "before")
    if start is not None and size <= BROADCAST_SLICE:
        offsets = F.broadcast(offsets)
    grouped = df.withColumn("group", F.shiftright(key, LEVEL_BITS))
    order = Window.partitionBy("group").orderBy(key)
    placed = grouped.join(offsets, "group").withColumn(
        "position", F.col("before") + F.row_number().over(order) - 1
    )
    if start is not None:
        placed = placed.where(F.col("position").between(start, start + size - 1))
    return placed.select(*df.columns, "position")


def with_rank(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """Add the 0-based position of each row by keys of any orderable types.

    Rows are dealt by sampled key ranges, sorted and counted inside each partition and
    written once; then the rows of earlier partitions are added.  No window sees the
    rows, only one count per partition.  Nulls come first unless ``order`` says otherwise.

    Ties: rows equal in all of ``order`` are ranked by where they are read, which also
    lets a key with a third of all rows be dealt to many tasks.  Pass a table that is
    read the same way every time (a written one), and a unique last key where ties matter.
    An empty table gives no rows; ``df`` must have no columns starting ``_rank_``.
    """
    keys = [*order, F.col("_rank_tie")]
    dealt = (
        df.withColumn("_rank_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_rank_tie")
    )
    folder = work_folder(df.sparkSession, "ranked")
    dealt.withColumn("_rank_tag", F.monotonically_increasing_id()).write.parquet(folder)
    part = F.shiftright("_rank_tag", PLACE_BITS).alias("_rank_part")
    tagged = df.sparkSession.read.parquet(folder).select("*", part)
    parts = tagged.groupBy("_rank_part").agg(F.count("*").alias("_rank_rows"))
    earlier = Window.orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rank_rows").over(earlier), F.lit(0))
    offsets = parts.select("_rank_part", before.alias("_rank_before"))
    if (tagged.agg(F.max("_rank_part")).first()[0] or 0) < BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    place = F.col("_rank_tag").bitwiseAND((1 << PLACE_BITS) - 1)
    return tagged.join(offsets, "_rank_part").select(
        *df.columns, (F.col("_rank_before") + place).alias(name)
    )
