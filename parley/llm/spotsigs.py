"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

An anchor is a run of common words; with the next two content words it makes a
spot.  The fingerprint of a text is the set of its spots, hashed.  A text without
anchors has its word pairs for spots, and one of less than two words itself, so equal
texts always have equal fingerprints.

Fingerprints are compared by Jaccard likeness.  For joins over all documents the sets
are partitioned by length: two sets can only be alike if the shorter has at least the
threshold's share of the longer's spots, so a set is compared within its own length
partition and the next, and only through its rarest spots, which two alike sets cannot
all miss.  Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stored
from parley.session import spread

#: Common words that anchor spots, for English, German, French and Spanish.
COMMON = (
    "a an and are as at be been but by can could did do for from had has have he her his"
    " i in is it its not of on or she so that the their there they this to was we were"
    " which will with would you"
    " als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es"
    " für hat ich ihr im ist mit nach nicht noch nur sich sie sind und von vor war wie wird"
    " zu zum zur über"
    " au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur"
    " mais ne nous ou où par pas plus pour qu que qui sa se ses son sont sur un une"
    " al como con cual de del desde donde el ella ellos en entre era es esta este fue ha hay la"
    " las lo los más me muy no o para pero por que se ser si sin sobre su sus también te un"
    " una y ya"
).split()
THRESHOLD = 0.8


def _any_of(words: list[str]) -> str:
    """Pattern for one of the words that shares their beginnings, so it fails early."""
    heads: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        if word:
            heads.setdefault(word[0], []).append(word[1:])
    parts = [head + _any_of(rest) for head, rest in heads.items()]
    if not parts:
        return ""
    whole = parts[0] if len(parts) == 1 and "" not in words else f"(?:{'|'.join(parts)})"
    return f"{whole}?" if "" in words else whole


_ANCHOR = _any_of(COMMON)


def with_spots(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sorted distinct 32-bit hashes of the spots of a text; null is empty.

    A spot is an anchor, the content word after it and the content word after that.
    The steps are columns of their own, so that none is computed twice.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]++", " "), F.lit(" "))
    # " of the big house " becomes " the#big house ": the last word of a run anchors
    marked = F.regexp_replace("words__", rf"(?: ({_ANCHOR})(?= ))++ ", " $1#")
    heads = F.regexp_extract_all("marked__", F.lit(r" ([^ #]++#[^ #]++)(?= (?:[^ #]++#)?+[^ #]++ )"), F.lit(1))
    tails = F.regexp_extract_all("marked__", F.lit(r"#[^ #]++(?= (?:[^ #]++#)?+([^ #]++) )"), F.lit(1))
    staged = (
        df.withColumn("words__", words)
        .withColumn("marked__", marked)
        .withColumns({"heads__": heads, "tails__": tails})
    )
    chains = F.transform(F.arrays_zip("heads__", "tails__"), lambda s: F.hash(s))
    pairs = F.transform(
        F.regexp_extract_all("words__", F.lit(r" (?=([^ ]++ [^ ]++) )"), F.lit(1)), lambda s: F.hash(s)
    )
    raw = F.when(F.size("heads__") > 0, chains).otherwise(
        F.concat(pairs, F.when(~F.col("words__").rlike(r"[^ ] [^ ]"), F.array(F.hash(F.lit("whole"), plain))).otherwise(F.array().cast("array<int>")))
    )
    out = staged.withColumn(name, F.array_sort(F.array_distinct(raw)))
    return out.drop("words__", "marked__", "heads__", "tails__")


def fingerprint(spots: Column) -> Column:
    """Digest of a set of spots."""
    return F.sha2(F.array_join(spots.cast("array<string>"), ","), 256)


def likeness(a: Column, b: Column, threshold: float | None = None) -> Column:
    """Jaccard likeness of two sets; with a threshold, 0 where lengths rule it out."""
    common = F.size(F.array_intersect(a, b))
    full = common / (F.size(a) + F.size(b) - common)
    if threshold is None:
        return full
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(shorter >= threshold * longer, full).otherwise(0.0)


def alike(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs a < b of distinct fingerprints that are alike, with their likeness.

    ``docs`` needs fingerprint and spots, as :func:`with_spots` and
    :func:`fingerprint` give them; equal fingerprints count once, so copies are never paired with each other.
    Each set is listed under its rarest spots, as many as two alike sets cannot both
    miss, and under its length partition and the next one, from which sets of the
    right length are compared in full.
    """
    sets = stored(docs.groupBy("fingerprint").agg(F.min("spots").alias("spots")), "spots")
    each = sets.select("fingerprint", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    frequency = each.groupBy("spot").agg(F.count("*").alias("sets"))
    ranked = each.join(frequency, "spot").groupBy("fingerprint", "n").agg(
        F.array_sort(F.collect_list(F.struct("sets", "spot"))).alias("ranked")
    )
    rare = F.expr(f"cast(n - ceil({threshold} * n) + 1 as int)")
    partition = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    listed = stored(
        ranked.select(
            "fingerprint", "n", partition.alias("part"), F.explode(F.slice("ranked", 1, rare)).alias("r")
        ).select("fingerprint", "n", "part", "r.spot"),
        "spot-index",
    )
    left = listed.select(F.col("fingerprint").alias("x"), F.col("n").alias("nx"), "part", "spot")
    right = listed.select(
        F.col("fingerprint").alias("y"), F.col("n").alias("ny"),
        F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "spot",
    )
    fits = (F.col("nx") <= F.col("ny")) & (F.col("nx") >= threshold * F.col("ny")) & (F.col("x") != F.col("y"))
    pairs = left.join(right, ["part", "spot"]).where(fits)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    a = sets.select(F.col("fingerprint").alias("a"), F.col("spots").alias("spots_a"))
    b = sets.select(F.col("fingerprint").alias("b"), F.col("spots").alias("spots_b"))
    compared = pairs.join(a, "a").join(b, "b").select(
        "a", "b", likeness(F.col("spots_a"), F.col("spots_b"), threshold).alias("likeness")
    )
    return compared.where(F.col("likeness") >= threshold)


def with_next(docs: DataFrame) -> DataFrame:
    """Each distinct document with the next one in descending order of doc_id, circular.

    ``docs`` has doc_id, kid (the id, not null), print (of id and text) and n_chars.  Ids
    are range-partitioned and sorted; positions within the partitions are joined, so no
    task sees more than its own range.  Null ids come last; equal ids go by print.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc_nulls_last("doc_id"), F.asc("print")]
    placed = stored(
        docs.distinct()
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()),
        "order",
    )
    # The first place of each partition follows the last of the one before it.
    part = F.shiftright("place", 33)
    ends = placed.groupBy(part.alias("part")).agg(F.min("place").alias("low"), F.max("place").alias("high"))
    bounds = sorted(ends.select("low", "high").collect())
    jumps = {bounds[i][1]: bounds[(i + 1) % len(bounds)][0] for i in range(len(bounds))}
    rows = [(high, low) for high, low in jumps.items()]
    table = docs.sparkSession.createDataFrame(rows, "place long, jump long")
    following = placed.select(
        F.col("place").alias("next_place"), F.col("kid").alias("next_kid"), F.col("print").alias("next_print")
    )
    linked = placed.join(F.broadcast(table), "place", "left").withColumn(
        "next_place", F.coalesce("jump", F.col("place") + 1)
    )
    return linked.join(following, "next_place").drop("place", "jump", "next_place")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, compared with each other.

    The edited text has the last third of the code points replaced by as many first ones
    (or all) of the next document in descending order of doc_id, the last being followed
    by the first.  Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    ``docs`` needs doc_id and text; other columns are left out.  A null text counts as
    empty; an empty text is edited to itself.  Null ids come last.  Rows that repeat id
    and text share one place in the order and are reported each.  An empty table gives
    none.  Texts are read whole.
    """
    text = F.coalesce("text", F.lit(""))
    rows = spread(docs.select("doc_id", text.alias("text"))).select(
        "doc_id",
        F.xxhash64("doc_id").alias("kid"),
        F.xxhash64(F.col("doc_id").isNull(), "text").alias("print"),
        "text",
    )
    sizes = rows.select("doc_id", "kid", "print", F.length("text").alias("n_chars"))
    links = stored(with_next(sizes), "next")
    # Both joins read the same columns, so the texts are shuffled once.  Spots are made
    # on either side of it: they are cheaper to find again than to move with the texts.
    texts = rows.select("kid", "print", "text")
    giver = texts.withColumnsRenamed({"kid": "next_kid", "print": "next_print"})
    given = (
        with_spots(links.join(giver, ["next_kid", "next_print"]), "text", "next_spots")
        .select(
            "kid", "print", "doc_id", "n_chars", "next_spots",
            F.expr("substring(text, 1, cast(floor(n_chars / 3) as int))").alias("head"),
        )
        .dropDuplicates(["kid", "print"])
    )
    joined = with_spots(texts.join(given, ["kid", "print"]), "text", "spots")
    kept = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))")
    edited = joined.select("doc_id", "n_chars", "spots", "next_spots", F.concat(kept, "head").alias("edited"))
    ready = with_spots(edited, "edited", "edited_spots")
    return ready.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )
