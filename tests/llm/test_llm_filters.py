"""Quality rules, toxicity and url verdicts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.llm import quality_rules, toxicity, url_filter

WORD = r"[^\x20\x09-\x0D]+"


def plain_measures(text):
    words = re.findall(WORD, text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if times[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(covered),
        len(lines),
    )


def test_measures_follow_the_definition():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("ab# \n|\t") for _ in range(rng.randrange(80)))
        assert quality_rules.measures(text) == plain_measures(text), text
    assert quality_rules.measures(None) == (0,) * 6


def test_quality_of_odd_rows(odd, none):
    judged = quality_rules.judged(odd)
    rows = judged.select("row.doc_id", "row.text", "n_words", "base_failed", "kept").collect()
    assert len(rows) == odd.count()
    for row in rows:
        words, _, _, _, repeats, _ = plain_measures(row["text"])
        assert row["base_failed"] == (words < 50 or 100 * repeats > 50 * words)
        assert not (row["kept"] and row["base_failed"])
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    assert quality_rules.keep_good(none).count() == 0
    assert quality_rules.judged(none).count() == 0


def test_thresholds_adapt_to_the_group(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(300):
        sharp = i % 2  # one source uses a symbol with every second word
        words = [word() + ("#" if sharp and k % 2 else "") for k in range(100)]
        rows.append((i, " ".join(words), "en", f"s{sharp}"))
    rows.append((1000, " ".join(word() + "#" * (k % 2) for k in range(100)), "en", "s0"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(frame).select("row.doc_id", "kept").collect()}
    assert all(kept[i] for i in range(300)) and not kept[1000]


def test_sketch_buckets(spark):
    values = spark.range(5000).withColumn("b", quality_rules.bucket(F.col("id"))).collect()
    assert all(r["b"] <= r["id"] and r["id"] - r["b"] <= r["id"] / 32 for r in values)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lexicon_equals_direct_search():
    rng = random.Random(5)
    terms = ["moron", "pathetic", "worthless", "scum", "stupid", "lowei*", "disgusti*", "chllab*"]
    lexicon = toxicity.FuzzyLexicon(terms)
    pool = [t.rstrip("*") for t in terms]
    for _ in range(4000):
        word = list(rng.choice(pool))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "o", "zz"])
        word = "".join(word)
        best = []
        for i, term in enumerate(terms):
            stem, letters = term.endswith("*"), term.rstrip("*")
            limit = toxicity.edits_allowed(letters, stem)
            ends = range(len(word) + 1) if stem else [len(word)]
            near = min((edits(word[:e], letters) for e in ends), default=99)
            if near <= limit:
                best.append((near, i))
        assert (lexicon.find(word) or (None,))[0] == min(best, default=(None,))[0], word


def test_quotation_and_address():
    lexicon = toxicity.FuzzyLexicon(["moron"])
    _, hits = toxicity.hits_in('He wrote "you moron" in a letter. ' + "filler " * 20 + "you morron there", lexicon)
    assert [(h.edits, h.quoted, h.addressed) for h in hits] == [(0, True, True), (1, False, True)]


def test_words_between_two_quotations_are_not_quoted():
    lexicon = toxicity.FuzzyLexicon(["moron"])
    for text, quoted in (
        ('"fine words" moron "other words"', False),
        ('she said "fine words" and "moron" again', True),
        ('an open " mark\nmoron "other words"', False),
        ("«moron» indeed", True),
    ):
        assert [h.quoted for h in toxicity.hits_in(text, lexicon)[1]] == [quoted]


def test_fitting_sees_every_hit(spark):
    """A text of a thousand clean words and then as many hits is fitted by all of them."""
    rows = [(i, f"moron {'moron ' * (900 * (i % 7 == 0))}you {i}", 1) for i in range(60)]
    rows += [(i, f"a quiet evening {i}", 0) for i in range(60, 200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    lexicon = toxicity.FuzzyLexicon(model.terms)
    fitted = [model.features(*toxicity.hits_in(text, lexicon)) for _, text, _ in rows]
    assert max(f[2] for f in fitted) > 6.5
    scores = {r.row.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert all((scores[i] >= 0.5) == bool(toxic) for i, _, toxic in rows)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.scored(docs, toxicity.fit(docs, labels))
    held = (
        scored.select("row.doc_id", "score").where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id")
    )
    found = Counter((r["toxic"], r["score"] >= 0.5) for r in held.collect())
    assert found[1, True] >= 0.85 * (found[1, True] + found[1, False])
    assert found[0, True] <= 0.01 * (found[0, True] + found[0, False])


def test_toxicity_of_odd_rows(odd, none, labels):
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    scores = toxicity.scored(odd, toxicity.fit(odd, labels)).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.drop_toxic(none, labels).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == odd.count()


URLS = [
    None, "", "nothing", "https://A.Example.NET/en/1?x=1", "http://example.net/de/2", "ftp://x.org/fr/",
    "https://example.com/de/9#t", "https://badexample.com/de/", "https://example.com", "https://org/fr/a",
    "://net/", "https://net", "https://ÄB.example.org/en/?", "https://a.example.net/EN/5", "http://x.y/?a=1&b=2",
]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h + p, verdict)
        for verdict, h, p in url_filter.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


@pytest.fixture(scope="module")
def urls(spark):
    many = URLS + [f"https://h{i % 9}.example.{s}/{p}/{i}" for i in range(90) for s in ("net", "com", "org") for p in ("en", "de", "fr")]
    rows = [(i, u, "h", "r", "l") for i, u in enumerate(many)] + [(None, URLS[3], "h", "r", "l")] * 2
    return spark.createDataFrame(rows, "page_id long, url string, host string, row string, label string")


def test_rules_equal_direct_search(urls):
    rows = url_filter.judged(urls).select("row.*", F.struct("host", "path", "rule", "verdict").alias("got")).collect()
    assert len(rows) == urls.count()
    for row in rows:
        host, path, rule, verdict = plain_rule(row["url"])
        got = row["got"]
        assert (got["host"], got["path"], got["rule"]) == (host, path, rule), row
        assert got["verdict"] == verdict if verdict else got["verdict"] in ("allow", "block")


def test_urls_without_labels(spark, urls):
    odd = spark.createDataFrame([(1, None), (2, "x"), (3, "http://q.zz/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judged(odd).collect()] == ["allow"] * 3
    assert url_filter.judged(urls.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "http://a.net/"), (2, "http://q.zz/")], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judged(same).collect()} == {"block"}


def test_shares_come_from_all_labelled_urls(spark):
    rules = [("block" if d % 2 else "allow", f"d{10 + d}.com", "/de/") for d in range(40)]
    rows = [(d, f"http://d{10 + d}.com/de/{i}") for d in range(40) for i in range(30)]
    asked = [(100 + d, f"http://d{10 + d}.com/en/1") for d in range(40)]
    frame = spark.createDataFrame(rows + asked, "page_id long, url string")
    judged = url_filter.judged(frame, rules, rows=40).where("row.page_id >= 100")
    got = {r["page_id"]: r["verdict"] for r in judged.select("row.page_id", "verdict").collect()}
    assert got == {100 + d: "block" if d % 2 else "allow" for d in range(40)}
