"""URL verdicts from rules and from gradient-boosted trees on lexical features.

Rules (a host with its subdomains, and the beginning of a path) decide where one fits,
the longest first.  The urls they decide are the labelled ones: all of them give the
block shares of suffixes and domains, and a bounded sample of them trains boosted trees
on length, depth, digit ratio, entropy, parameter counts and those shares; the trees
decide all other urls.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import look_up, stored

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Rules written into the plan; longer lists are refused.
MOST_RULES = 200
#: Labelled urls used for training, chosen by a hash of the url.
TRAIN_ROWS = 10_000
TREES, DEPTH = 15, 4
FEATURES = [
    "url_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio", "host_digits",
    "hyphens", "entropy", "parameters", "query_chars", "fragment", "secure", "extension",
    "suffix_share", "domain_share",
]


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A to Z lower-cased) and path; both empty without ``://``."""
    found = F.col(url).contains("://")
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.when(found, host).otherwise("")).withColumn(
        "path", F.when(found, path).otherwise("")
    )


def rule_for(rules=RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits host and path, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    cases = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits = fits & F.col("path").startswith(path)
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return cases


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    letters = F.array_distinct(F.split(text, ""))
    size = F.length(text)

    def part(letter: Column) -> Column:
        times = (size - F.length(F.replace(text, letter, F.lit("")))) / size
        return F.when(times > 0, -times * F.log2(times)).otherwise(0.0)

    summed = F.aggregate(letters, F.lit(0.0), lambda total, letter: total + part(letter))
    return F.when(size > 0, summed).otherwise(0.0)


def with_features(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features, suffix and domain; a null url counts as empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)

    def count(column: Column, pattern: str) -> Column:
        return F.regexp_count(column, F.lit(pattern)).cast("double")

    columns = {
        "url_chars": F.length(text),
        "host_chars": F.length("host"),
        "path_chars": F.length("path"),
        "depth": count(F.col("path"), "/[^/]"),
        "labels": count(F.col("host"), r"[^.]+"),
        "digit_ratio": F.when(text != "", count(text, "[0-9]") / F.length(text)).otherwise(0.0),
        "host_digits": count(F.col("host"), "[0-9]"),
        "hyphens": count(text, "-"),
        "entropy": _entropy(text),
        "parameters": count(query, "[^&=]+="),
        "query_chars": F.length(query),
        "fragment": text.contains("#"),
        "secure": text.startswith("https:"),
        "extension": F.col("path").rlike(r"\.[A-Za-z0-9]+$"),
    }
    named = pages.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()})
    return with_domains(named)


def with_domains(pages: DataFrame) -> DataFrame:
    """Adds the host's suffix and domain."""
    return pages.withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0)).withColumn(
        "domain", F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0)
    )


def _label_counts(labelled: DataFrame) -> DataFrame:
    """Distinct labelled urls and blocked ones among them, per suffix and domain."""
    named = with_domains(labelled.distinct())
    counts = named.groupBy("suffix", "domain").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    return stored(counts, "url-labels")


def _shares(counts: DataFrame, key: str, prior: float) -> DataFrame:
    """Smoothed share of blocked urls per key."""
    share = (F.sum("blocked") + 4 * F.lit(prior)) / (F.sum("n") + 4)
    return stored(counts.groupBy(key).agg(share.alias(f"{key}_share")), "url-shares")


def _with_shares(rows: DataFrame, shares: list[DataFrame], prior: float) -> DataFrame:
    for table in shares:
        key = table.columns[0]
        rows = look_up(rows, table, [key], F.monotonically_increasing_id()).fillna(prior, [f"{key}_share"])
    return rows


def judged(pages: DataFrame, rules=RULES, rows: int = TRAIN_ROWS) -> DataFrame:
    """Struct ``row`` (all columns of ``pages``), host, path, rule and verdict.

    Null urls and urls without ``://`` have empty host and path and are judged by the
    trees.  If the rules label no urls, all others are allowed; if they label all alike,
    so are the others.  Repeated rows are judged alike; an empty table gives none;
    columns with clashing names stay inside ``row``.
    """
    inner = with_parts(pages.select(F.struct(*pages.columns).alias("row"), "url"))
    inner = inner.withColumn("fitting", rule_for(rules))
    labelled = inner.where("fitting is not null").select(
        "url", "host", "path", (F.col("fitting.verdict") == "block").cast("double").alias("label")
    )
    counts = _label_counts(labelled)
    n, blocked = counts.select(F.sum("n"), F.sum("blocked")).first()
    out = ["row", "host", "path", "fitting.rule"]
    if not n or blocked in (0, n):
        other = F.lit("block" if blocked else "allow")
        return inner.select(*out, F.coalesce("fitting.verdict", other).alias("verdict"))
    prior = blocked / n
    shares = [_shares(counts, key, prior) for key in ("suffix", "domain")]
    sample = labelled.distinct().orderBy(F.xxhash64("url"), "url").limit(rows)
    train = stored(with_features(sample).coalesce(1), "url-train")
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model: GBTClassificationModel = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxBins=64, cacheNodeIds=False
    ).fit(assemble.transform(_with_shares(train, shares, prior)).select("features", "label"))
    ready = assemble.transform(_with_shares(with_features(inner), shares, prior))
    predicted = model.transform(ready.drop("label", "prediction"))
    method = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return predicted.select(*out, F.coalesce("fitting.verdict", method).alias("verdict"))
