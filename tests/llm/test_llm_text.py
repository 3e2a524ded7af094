"""Personal data, language-model scores, near duplicates, fingerprints and pages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import html_main, lm_score, order_minhash, pii, spotsigs


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def plain_spans(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_fixed_forms_equal_direct_search(spark):
    rng = random.Random(5)
    parts = list("ab.@%+- 019é🙂().\n") + ["4587121519400672", "1.2.3.4", "a@b.c", "+1 (988) 555-2485", "256.1.1.1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", "1 " * 3000, "a" * 9000 + "@", "1." * 3000, "+1" + "-" * 9000, "9" * 9000, "a.b@c.d_x@e.f@g.h"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    for row in frame.select("text", pii.base_spans(F.col("text")).alias("s")).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in row["s"]] == plain_spans(row["text"]), row["text"]


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(6)
    key = lambda n=18: "".join(rng.choice("0123456789abcdef") for _ in range(n - 1)) + "7"
    shared = [key() for _ in range(6)]
    rows = [(i, f"some words password={k} more") for i, k in enumerate(shared)]
    # the same values under another label carry the pattern over to new values
    rows += [(10 + i, f"again vault: {k} here") for i, k in enumerate(shared)]
    fresh = key()
    rows += [(100, f"new vault: {fresh} end"), (101, f"nothing near {key()} at all"), (102, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: [s["value"] for s in r["spans"]] for r in pii.found(frame).select("row.doc_id", "spans").collect()}
    assert found[100] == [fresh] and found[0] == [shared[0]] and found[101] == [] and found[102] == []


def test_masking_odd_rows(spark, odd, none):
    masked = pii.mask(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    for row in masked.select("text", "n_chars").where("text is not null").collect():
        assert not plain_spans(row["text"]) and (row["n_chars"] is None or row["n_chars"] == len(row["text"]))
    assert masked.where("text is null").count() == odd.where("text is null").count()
    assert pii.mask(none).count() == 0
    one = spark.createDataFrame([("q a@b.c +1 (988) 555-2485 x 1.2.3.4 é",)], "text string")
    assert pii.mask(one).first()["text"] == "q [EMAIL] [PHONE] x [IP] é"


def test_running_sums_and_maxima(spark):
    rng = random.Random(31)
    lists = [[rng.randrange(90) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 16, 17, 400, 1000)]
    frame = spark.createDataFrame([(x,) for x in lists], "a array<int>")
    both = frame.select("a", pii._running(F.col("a"), pii._sum).alias("s"), pii._running(F.col("a"), pii._most).alias("m"))
    for row in both.collect():
        assert row["s"] == [sum(row["a"][:i]) for i in range(len(row["a"]))]
        assert row["m"] == [max([0, *row["a"][:i]]) for i in range(len(row["a"]))]


def plain_candidates(text):
    out = []
    for m in re.finditer(r"[^\s\x00-\x1f\x7f\"'`<>()\[\]{},;:=#|&$%*!?]+", text):
        value = m[0]
        while value and not value[-1].isalnum():
            value = value[:-1]
        behind = re.search(r"[A-Za-z_][\x20\t]{0,2}[=:#][\x20\t]{0,2}[\"']?\Z", text[: m.start()])
        label = re.match(r"[\x20\t]*[=:#]", text[m.end() :])
        if len(value) >= 4 and (re.search("[0-9]", m[0]) or behind and not label):
            out.append((m.start(), m.start() + len(value), value))
    return out


def test_candidates_equal_direct_search(spark):
    rng = random.Random(32)
    parts = ["ab1", "word", "pass_word", "=", ":", " ", "  ", '"', "'", "x9y8z7", ".", "-", "é", "🙂", "12345", "!", "(", "\n", "\t", "#"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    for row in frame.select("text", pii.candidates(F.col("text")).alias("c")).collect():
        assert [(c["start"], c["end"], c["value"]) for c in row["c"]] == plain_candidates(row["text"]), row["text"]


def plain_extra(rows, seed_labels):
    """Identifiers of (doc, base spans, nodes) rows, by pattern scores over dictionaries."""
    edges, places = {}, []
    for doc, nodes in rows:
        for node in nodes:
            for pattern in node["patterns"]:
                name, label = pattern.split("|")[:2]
                labelled = name == "label" and label in seed_labels and bool(re.search("[0-9]", node["value"]))
                key = re.fullmatch("[0-9A-Fa-f]{32,}", node["value"]) and re.search("[0-9]", node["value"])
                key = bool(key and re.search("[A-Fa-f]", node["value"]))
                edge = (pattern, node["value"])
                edges[edge] = edges.get(edge, False) or node["base"] or labelled or key
                places.append((doc, node, pattern, labelled))
    of = {}
    for pattern, value in edges:
        of.setdefault(pattern, set()).add(value)
    score = {}
    for (_, value), seed in edges.items():
        score[value] = max(score.get(value, 0.0), float(seed))
    for turn in range(pii.ROUNDS):
        worth = {p: sum(score[v] for v in values) / len(values) for p, values in of.items()}
        good = {p: w for p, w in worth.items() if w >= pii.CONFIDENT and len(of[p]) >= pii.LEAST_VALUES}
        fresh = {}
        for (pattern, value), seed in edges.items():
            fresh[value] = max(fresh.get(value, 0.0), float(seed), good.get(pattern, 0.0))
        score = fresh
    return {
        (doc, node["start"], node["end"])
        for doc, node, pattern, labelled in places
        if not node["base"] and (labelled or pattern in good)
    }


@pytest.mark.parametrize("seed_labels", [pii.SEED_LABELS, ()])
def test_identifiers_equal_direct_scores(spark, seed_labels):
    rng = random.Random(33)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    values = [key(rng.choice((10, 36, 40))) for _ in range(25)]
    values += [f"u{i}@mail.example.org" for i in range(6)] + [f"10.0.3.{i}" for i in range(6)]
    values += ["Ab12_x9", "2024-01", "ABC-1234", "ABC-4321", "ABC-7777", "plain"]
    before = ["token = ", 'token: "', "from ", "our vault ", "sent to ", "ref=", "password:", "id "]
    texts = []
    for _ in range(160):
        parts = [rng.choice(("of", "and", "then")) + " " + rng.choice(before) + rng.choice(values) for _ in range(rng.randrange(4))]
        texts.append(rng.choice(("\n", " ")).join(parts) + rng.choice(("", " now", " at home")))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    text = F.col("text")
    found = F.array_sort(F.concat(pii.base_occurrences(text), pii.candidates(text)))
    nodes = frame.select("doc_id", pii.nodes(found).alias("n")).collect()
    for row in nodes:  # overlaps with fixed forms, seen from the text itself
        base = plain_spans(texts[row["doc_id"]])
        for node in row["n"]:
            assert node["base"] == any(s < node["end"] and node["start"] < e for s, _, e in base)
    want = plain_extra([(r["doc_id"], r["n"]) for r in nodes], seed_labels)
    got = set()
    for row in pii.found(frame, carry=["doc_id"], seed_labels=seed_labels).select("row.doc_id", "spans").collect():
        got |= {(row["doc_id"], s["start"], s["end"]) for s in row["spans"] if s["kind"] == 4}
    assert got == want and len(want) > 20


def test_words_around_entities_are_patterns(spark):
    texts = [f"please reach u{i}@mail.example.org or wait" for i in range(12)] + ["please reach Zq7_81aa or wait"]
    texts += [f"room Zq7_9{i} is open" for i in range(5)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: [s["value"] for s in r["spans"]] for r in pii.found(frame, seed_labels=()).select("row.doc_id", "spans").collect()}
    assert spans[12] == ["Zq7_81aa"] and all(spans[13 + i] == [] for i in range(5))


def plain_masked(text, spans):
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{pii.KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_masking_of_many_matches_in_long_texts(spark):
    rng = random.Random(34)
    fill = lambda n: "".join(rng.choice("ab é🙂\n") for _ in range(n))
    form = lambda: rng.choice(["a@b.c", "1.2.3.4", "+1 (988) 555-2485", "4587121519400672", "x+1 988 555-2485@q.de"])
    texts = [" ".join(fill(rng.choice((0, 3, 50, 4094, 9000))) + " " + form() for _ in range(rng.randrange(6))) for _ in range(60)]
    texts += ["; ".join(f"u{i}@a.bc 1.2.3.{i % 250}" for i in range(20_000)), "a" * 4096, "a@b.c" + "y " * 2046 + "a@b.c"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    spans = frame.select("text", pii.base_spans(F.col("text")).alias("s"))
    for row in spans.withColumn("m", pii.masked(F.col("text"), F.col("s"))).collect():
        own = [(s["start"], s["kind"], s["end"]) for s in row["s"]]
        assert own == plain_spans(row["text"])
        assert row["m"] == plain_masked(row["text"], own)


def plain_lm(docs):
    words = [(k, lm_score.tokens_of(t)) for k, t in docs]
    train = [w for k, w in words if k is None or zlib.crc32(str(k).encode()) % 10]
    counts = Counter(t for w in train for t in w)
    n, v = sum(counts.values()), len(counts)
    rows = []
    for k, w in words:
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w)
        rows.append((k, len(w), sum(counts[t] > 0 for t in w), n, round(base, 6)))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_base_scores_and_passes(odd, monkeypatch, small):
    if small:  # several segments, several passes, a head of a few words
        monkeypatch.setattr(lm_score, "PASS_BYTES", 1 << 10)
        monkeypatch.setattr(lm_score, "SEGMENT_TOKENS", 1 << 13)
        monkeypatch.setattr(lm_score, "HEAD", 4)
    rows = lm_score.scored(odd).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=repr)
    assert got == plain_lm([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    assert all(r["score"] < 0 and r["held_out"] == lm_score.is_held_out(r["doc_id"]) for r in rows)


def plain_scores(docs):
    """Scores with the counts of words and pairs replaced by the means of their levels."""
    words = [(k, lm_score.tokens_of(t)) for k, t in docs]
    train = [w for k, w in words if k is None or zlib.crc32(str(k).encode()) % 10]
    single = Counter(t for w in train for t in w)
    pairs = Counter(p for w in train for p in zip([None, *w], w))
    n, v = sum(single.values()), len(single)

    def quantised(counts):
        levels = {}
        for c in counts.values():
            levels.setdefault(c.bit_length(), []).append(c)
        means = {k: sum(c) / len(c) for k, c in levels.items()}
        return lambda item: means[counts[item].bit_length()] if counts[item] else 0.0

    one, two = quantised(single), quantised(pairs)
    rows = {}
    for k, w in words:
        total = 0.0
        for before, t in zip([None, *w], w):
            lower = (one(t) + 0.1) / (n + 0.1 * (v + 1))
            seen = len(train) if before is None else one(before)
            upper = min(1.0, two((before, t)) / seen) if seen else 0.0
            weight = 0.3 if seen else 0.0
            total += math.log10(weight * upper + (1 - weight) * lower)
        rows.setdefault(k, []).append((len(w), total))
    return rows


def test_scores_equal_exact_counts_but_for_false_hits(spark):
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(700)]
    text = lambda: " ".join(pool[min(int(rng.expovariate(0.02)), 699)] for _ in range(rng.randint(0, 90)))
    docs = [(i, text()) for i in range(400)] + [(None, "abc abc"), (500, None), (501, ""), (502, "QQQ Abc")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = plain_scores(docs)
    exact, off, tokens = 0, 0.0, 0
    for row in lm_score.scored(frame).select("doc_id", "n_tokens", "score").collect():
        ((n, score),) = want[row["doc_id"]]
        # a false hit puts an n-gram one level up, about 0.3 in log10
        assert row["n_tokens"] == n and abs(row["score"] - score) < 0.05 * n + 0.7, row
        exact += abs(row["score"] - score) < 1e-6
        off, tokens = off + abs(row["score"] - score), tokens + n
    assert exact > 0.3 * len(docs) and off < 0.01 * tokens


def test_steps_do_not_grow_with_the_filter(spark, monkeypatch):
    """A filter of many segments takes no more passes over the texts, and the scores stay right."""
    rng = random.Random(23)
    words = lambda: " ".join(f"w{int(rng.expovariate(0.01))}" for _ in range(rng.randint(0, 60)))
    docs = [(i, words()) for i in range(300)] + [(None, "w1 w2"), (500, None), (501, "unseen pair")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want, steps, kept = plain_scores(docs), [], lm_score.stored
    monkeypatch.setattr(lm_score, "stored", lambda df, purpose: steps.append(purpose) or kept(df, purpose))
    lm_score.scored(frame).count()
    few = list(steps)
    for name, value in (("SEGMENT_TOKENS", 1 << 8), ("PASS_BYTES", 1 << 9), ("CHUNK_BYTES", 1 << 11)):
        monkeypatch.setattr(lm_score, name, value, raising=False)
    steps.clear()
    rows = lm_score.scored(frame).select("doc_id", "n_tokens", "score").collect()
    assert steps == few
    assert len(rows) == len(docs)
    exact, off, tokens = 0, 0.0, 0
    for row in rows:
        ((n, score),) = want[row["doc_id"]]
        assert row["n_tokens"] == n and abs(row["score"] - score) < 0.05 * n + 0.7, row
        exact += abs(row["score"] - score) < 1e-6
        off, tokens = off + abs(row["score"] - score), tokens + n
    assert exact > 0.3 * len(docs) and off < 0.01 * tokens


def test_segments_answer_like_the_whole_filter():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sent = []
    for chunk in range(5):
        row = {"segment": 0, "chunk": chunk}
        for kind in (1, 2):
            hashes = np.unique(rng.integers(0, 400, rng.integers(0, 300)).astype(np.uint64) * np.uint64(1 << 53))
            once = rng.random(len(hashes)) < 0.5
            row[f"once{kind}"], row[f"more{kind}"] = hashes[once].tobytes(), hashes[~once].tobytes()
            # 0: in held-out documents only
            row[f"times{kind}"] = rng.choice([0, 2, 9], int((~once).sum())).astype("<u4").tobytes()
        sent.append(row)
    schema = pa.schema(
        [("segment", pa.int32()), ("chunk", pa.int64())]
        + [(n, pa.binary()) for n in (*lm_score._HASHES, *lm_score._TIMES)]
    )
    got = lm_score.answered(pa.Table.from_pylist(sent, schema)).to_pylist()
    rows = [
        {"kind": k, "once": r[f"once{k}"], "more": r[f"more{k}"], "times": r[f"times{k}"]} for r in sent for k in (1, 2)
    ]
    data, tallies = lm_score._segment(rows)
    whole = lm_score.Filter(0, {0: data})
    assert [r["tallies"] for r in got] == [tallies, None, None, None, None]
    for asked, answer in zip(sent, got):
        assert asked["chunk"] == answer["chunk"]
        for name in lm_score._HASHES:
            assert answer[name] == whole.levels(np.frombuffer(asked[name], np.uint64)).tobytes()


def test_tokens_as_arrays():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(22)
    for block in (1, 7, 1 << 19):
        seen = {}
        for _ in range(60):
            texts = ["".join(rng.choice("aAbß é\n\t\x0b\x1c🙂") for _ in range(rng.randrange(30))) for _ in range(7)]
            column = pa.array([None, *texts, "", None]).slice(rng.randrange(2))
            got = []
            for _, tokens in lm_score.chunks(column, rng.choice([1, 40, 1000])):
                words = [w.encode() for w in tokens.written(np.arange(len(tokens.hashes))).to_pylist()]
                starts = np.flatnonzero(np.array([w != lm_score.END for w in words], bool))
                assert len(starts) == len(tokens.words)
                again = lm_score.word_hashes(tokens.data, tokens.words, block)
                assert (again == tokens.hashes[starts]).all()
                assert all(seen.setdefault(w, h) == h for w, h in zip(words, tokens.hashes.tolist()))
                got += [words[a : a + n] for a, n in zip(tokens.starts, tokens.sizes)]
            assert got == [lm_score.tokens_of(t) for t in column.to_pylist()]
        assert len(set(seen.values())) == len(seen)
    assert not list(lm_score.chunks(pa.array([], pa.string()), 10))


def test_scores_without_documents(none, spark):
    assert lm_score.scored(none).count() == 0
    held = next(i for i in range(100) if lm_score.is_held_out(i))
    row = lm_score.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert row["train_tokens"] == 0 and row["base_score"] == 0 and row["n_known"] == 0


def test_filter_gives_levels():
    import numpy as np

    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)
    counts = rng.integers(1, 500, 5000)
    rows = [{"kind": 2, "once": b"", "more": hashes.tobytes(), "times": counts.astype("<u4").tobytes()}]
    data, tallies = lm_score._segment(rows)
    levels = lm_score.Filter(0, {0: data}).levels(hashes)
    want = np.floor(np.log2(counts)).astype(int) + 1
    assert (levels >= want).all() and (levels == want).mean() > 0.95
    assert sum(tallies[3]) == counts.sum() and sum(tallies[2]) == len(hashes)
    unseen = lm_score.Filter(0, {0: data}).levels(rng.integers(0, 2**63, 5000).astype(np.uint64))
    assert (unseen > 0).mean() < 0.05


def word_likeness(a, b):
    """Longest common subsequence of the words over the longer text's words."""
    a, b = ((t or "").lower().split() for t in (a, b))
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1] / max(len(a), len(b))


def plain_classes(docs):
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    words = [set((t or "").lower().split()) for _, t in docs]
    for i in range(len(docs)):
        for j in range(i):
            # texts of so few common words are nowhere near
            if len(words[i] & words[j]) >= 0.5 * max(len(words[i]), len(words[j])) and find(i) != find(j):
                if word_likeness(docs[i][1], docs[j][1]) >= 0.8:
                    parent[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, groups.values()))


def classes_of(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    classes, _ = order_minhash.classified(frame)
    got = {}
    for row in classes.select("row.doc_id", "class_id", "class_size", "keeper").collect():
        got.setdefault(row["class_id"], set()).add(row["doc_id"])
        assert row["keeper"] == (row["doc_id"] == row["class_id"])
    return sorted(map(sorted, got.values()))


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    docs = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        docs.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4, 12])):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    docs = [(i, t) for i, t in enumerate(docs)]
    assert classes_of(spark, docs) == plain_classes(docs)


def edited(words, share, rng, vocabulary):
    """Words replaced, put in and left out in a share of the places."""
    out = []
    for word in words:
        kind = rng.choice(["replace", "insert", "delete"]) if rng.random() < share else "keep"
        if kind in ("replace", "insert"):
            out.append(rng.choice(vocabulary))
        if kind in ("keep", "insert"):
            out.append(word)
    return out


def test_edited_copies_are_found(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    docs = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(80, 400))]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited(words, rng.uniform(0.01, 0.1), rng, vocabulary)))]
    wanted = {(i, i + 1) for i in range(0, 300, 2) if word_likeness(docs[i][1], docs[i + 1][1]) >= 0.8}
    got = classes_of(spark, docs)
    assert all(len(c) == 1 or tuple(c) in wanted for c in got)
    assert len(wanted) >= 140 and sum(len(c) == 2 for c in got) >= 0.9 * len(wanted)


def test_texts_that_share_a_passage(spark, monkeypatch):
    """A passage of half a text, in more classes than a bucket compares, hides no copies."""
    monkeypatch.setattr(order_minhash, "CLASSES", 8)
    made = []
    accepted = order_minhash._accepted
    monkeypatch.setattr(order_minhash, "_accepted", lambda pairs, texts: made.append(pairs.count()) or accepted(pairs, texts))
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(900)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for k in range(80):
        own = [rng.choice(vocabulary) for _ in range(60)]
        docs.append(" ".join(own[:20] + passage + own[20:]))
        if k % 10 == 0:
            own = edited(own, 0.03, rng, vocabulary)
            docs.append(" ".join(own[:20] + passage + own[20:]))
    docs = list(enumerate(docs))
    assert classes_of(spark, docs) == plain_classes(docs)
    assert sum(made) < 12 * len(docs)


def test_links_of_large_buckets_are_not_lost(spark, monkeypatch):
    """In buckets of many classes, texts are linked that are near no other member, and classes
    by members that are not their first."""
    monkeypatch.setattr(order_minhash, "CLASSES", 8)
    rng = random.Random(13)
    fresh = (f"w{i}" for i in range(10**6))
    passage = [next(fresh) for _ in range(70)]
    docs = []
    for k in range(60):
        own = [next(fresh) for _ in range(30)]
        docs.append(" ".join(passage + own))
        if k % 6 == 0:  # a chain: neighbours have 82 of 100 words in common, others 70
            for _ in range(3):
                own = own[18:] + [next(fresh) for _ in range(18)]
                docs.append(" ".join(passage + own))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    want = plain_classes(docs)
    assert 10 <= sum(len(c) > 1 for c in want)
    assert classes_of(spark, docs) == want


def test_words_in_common_are_never_understated():
    rng = random.Random(14)
    tool = order_minhash.Shingler()
    texts = []
    for _ in range(60):
        vocabulary = [f"v{i}".encode() for i in range(rng.choice([2, 20, 400]))]
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 300))]
        texts += [words, edited(words, rng.uniform(0, 0.2), rng, vocabulary) or words]
    rows = {
        "uid": np.arange(len(texts)), "comp": np.arange(len(texts)), "side": np.zeros(len(texts), int),
        "n": np.array([len(t) for t in texts]),
        "bits": np.array([tool.bit_set(t).tobytes() for t in texts], object),
    }
    got = set(zip(*(x.tolist() for x in order_minhash._of_group(rows, best=False))))
    pairs = {(i, j) for j in range(len(texts)) for i in range(j)}
    near = {(i, j) for i, j in pairs if order_minhash.aligned(texts[i], texts[j]) >= 0.8}
    assert len(near) >= 40 and near <= got and len(got) < len(pairs) / 4
    rows["side"] = np.arange(len(texts)) % 2
    crossed = set(zip(*(x.tolist() for x in order_minhash._of_group(rows, best=False))))
    assert crossed == {(i, j) for i, j in got if (i + j) % 2}


def test_repeated_shingle_changes_one_label_only():
    words = [f"a{i}".encode() for i in range(50)]
    tool = order_minhash.Shingler()
    again = tool.labelled(words + words[:5])
    assert set(tool.labelled(words)) <= set(again) and len(set(again)) == len(again)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)] + [(200, 201), (300, 300)]
    edges = spark.createDataFrame([*chain, *star, *star], "a long, b long")
    got = {}
    for row in order_minhash.components(edges).collect():
        got.setdefault(row["comp"], set()).add(row["node"])
    assert sorted(map(sorted, got.values())) == [list(range(41)), list(range(100, 140)), [200, 201]]
    assert all(comp in nodes for comp, nodes in got.items())


def test_large_group_of_edited_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(900)]
    words = [rng.choice(vocabulary) for _ in range(120)]
    docs = [(i, " ".join(edited(words, 0.04, rng, vocabulary))) for i in range(400)]
    assert len(classes_of(spark, docs)) == 1


def test_order_matters():
    words = [f"a{i}".encode() for i in range(200)]
    assert order_minhash.aligned(words, words) == 1
    assert order_minhash.aligned(words, words[100:] + words[:100]) < 0.8
    assert order_minhash.aligned(words, words[:90]) == 0
    changed = list(words)
    changed[50] = b"new"
    assert order_minhash.aligned(words, changed) == pytest.approx(199 / 200)


@pytest.mark.parametrize("block", [7, 1024])
def test_alignment_equals_full_table(monkeypatch, block):
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    rng = random.Random(12)
    for _ in range(500):
        vocabulary = [f"v{i}" for i in range(rng.choice([2, 5, 50]))]
        a = [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        b = edited(a, rng.uniform(0, 0.3), rng, vocabulary) or a
        want = word_likeness(" ".join(a), " ".join(b))
        got = order_minhash.aligned(a, b)
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or got == pytest.approx(want))


def test_near_duplicates_of_odd_rows(odd, none):
    kept = order_minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    texts = Counter(" ".join((r["text"] or "").lower().split()) for r in kept.collect())
    assert all(n == 1 for t, n in texts.items() if t)
    wordless = odd.where("text is null or trim(translate(text, '\\n\\t', '  ')) = ''").count()
    assert texts[""] == wordless
    assert order_minhash.keep_one(none).count() == 0


def plain_spots(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    common = set(spotsigs.COMMON)
    content = [i for i, w in enumerate(words) if w not in common]
    out = {
        (words[i - 1], words[i], words[j])
        for i, j in zip(content, content[1:])
        if i and words[i - 1] in common
    }
    return out or set(zip(words, words[1:])) or {text}


def test_spotsigs_equal_direct_search(spark, odd):
    rows = [(i, t) for i, t in enumerate(["the big house of cards is the best house", "", None, "one", "a b a", "of the in"])]
    rng = random.Random(9)
    words = ["the", "of", "and", "red", "blue", "house", "river", "sky,", "Der", "Haus", "é"]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(80)]
    frame = spark.createDataFrame(rows + [rows[10], rows[10]], "doc_id long, text string").repartition(5)
    texts = {k: t or "" for k, t in rows}
    ids = sorted(texts, reverse=True)
    follows = dict(zip(ids, ids[1:] + ids[:1]))
    got = spotsigs.compared_with_next(frame).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([*ids, rows[10][0], rows[10][0]])
    for row in got:
        own, other = texts[row["doc_id"]], texts[follows[row["doc_id"]]]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + other[:cut]
        assert row["n_chars"] == len(own) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = plain_spots(own), plain_spots(edited), plain_spots(other)
        assert row["near_edited"] == pytest.approx(len(a & b) / len(a | b)), (own, edited)
        assert row["near_next"] == pytest.approx(len(a & c) / len(a | c))
    assert spotsigs.compared_with_next(odd).count() == odd.count()
    assert spotsigs.compared_with_next(odd.limit(0)).count() == 0


def test_alike_equals_all_pairs(spark):
    rng = random.Random(10)
    base = [rng.sample(range(400), 40) for _ in range(30)]
    sets = [sorted(set(b) - set(rng.sample(b, rng.randrange(6)))) for b in base for _ in range(4)]
    frame = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate(sets)], "fingerprint string, spots array<int>")
    got = {(r["a"], r["b"]) for r in spotsigs.alike(frame).collect()}
    names = [f"f{i}" for i in range(len(sets))]
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            if len(a & b) >= 0.8 * len(a | b):
                want.add(tuple(sorted((names[i], names[j]))))
    assert got == want


def test_patterns_of_entities_and_any_length(spark):
    texts = ["the password: zq81hv0aa9 and more", "token=77aa12345b"]  # one value each
    texts += [f"contact: u{i}@mail.example.org" for i in range(30)] + ["contact: Qx81_72hz5tt"]
    texts += [f"ticket: {'ab12' * (2 + i)}zz" for i in range(4)]  # no known value
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: [s["value"] for s in r["spans"]] for r in pii.found(frame).select("row.doc_id", "spans").collect()}
    assert (spans[0], spans[1]) == (["zq81hv0aa9"], ["77aa12345b"])
    assert spans[2] == ["u0@mail.example.org"] and spans[32] == ["Qx81_72hz5tt"]
    assert all(spans[33 + i] == [] for i in range(4))


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a>Menu</a></li></ul></nav><div>Site notice of host {host}</div>{main}"
    "<div class='comments'><p>reader says</p></div><footer>&copy; x</footer></body></html>"
)


def test_templates_and_articles(spark):
    plain = lambda i: f"<div><h1>Head {i}</h1><p>Body &amp; text {i}<br>more<p>Next  one {i}</div>"
    article = lambda i: f"<article><h1>Head {i}</h1><p>Shared line</p><p>Own {i}</p><aside>side</aside></article>"
    rows = [(i, f"https://A.example.com/{i}", PAGE.format(host="a", main=plain(i))) for i in range(12)]
    rows += [(50 + i, f"http://b.example.com/{i}", PAGE.format(host="b", main=article(i))) for i in range(12)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://c.d/", "just &lt;text"), (None, "http://c.d/", "<p>a<p>b")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    texts = {r["page_id"]: r["main_text"] for r in html_main.extracted(frame).select("row.page_id", "main_text").collect()}
    for i in range(12):
        assert texts[i] == f"Head {i}\nBody & text {i} more\nNext one {i}"
        assert texts[50 + i] == f"Head {i}\nShared line\nOwn {i}"
    assert (texts[90], texts[91], texts[92], texts[None]) == ("", "", "just <text", "a\nb")
    assert html_main.extracted(frame.limit(0)).count() == 0


def main_texts(spark, pages):
    """Main text by page number; pages are (host, html)."""
    rows = [(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    return {r["page_id"]: r["main_text"] for r in html_main.extracted(frame).select("row.page_id", "main_text").collect()}


def test_templates_inside_articles(spark):
    stub = "<div class='xq'><p>Tell us what you think</p></div><div>{quote}</div><p class='z'>Buy now</p>"
    page = "<body><article><h1>H {i}</h1><p>Quoted line</p><p>Own words number {i}</p>" + stub + "</article></body>"
    own = [("a.b", page.format(i=i, quote="Quoted div")) for i in range(8)]
    copies = [("c.d", f"<body><p>ad {i}</p><article><div class='t'>Copied words</div></article></body>") for i in range(8)]
    dated = [("e.f", f"<main><div><p>{'Copied words ' * 9}</p></div><p>{i} May</p></main>") for i in range(8)]
    texts = main_texts(spark, own + copies + dated)
    for i in range(8):
        assert texts[i] == f"H {i}\nQuoted line\nOwn words number {i}\nQuoted div"
        assert texts[8 + i] == "Copied words"
        assert texts[16 + i] == f"{('Copied words ' * 9).strip()}\n{i} May"


def test_copies_and_sections_of_a_host(spark):
    copies = [("g.h", "<body><div><p>Copied words</p></div></body>")] * 8
    copies += [("g.h", f"<body><p>Single page {i}</p></body>") for i in range(8)]
    page = "<body><div><ul><li>Menu of {s}</li></ul></div><p>Common line {t}</p><p>Words of page {i}</p></body>"
    hot = [("hot", page.format(s=i % 5, t=i % 4, i=i)) for i in range(300)]
    texts = main_texts(spark, copies + hot)
    assert all(texts[i] == "Copied words" for i in range(8))
    assert all(texts[16 + i] == f"Common line {i % 4}\nWords of page {i}" for i in range(300))


def test_broken_markup():
    text = lambda html: html_main.main_text(html_main.parse(html), frozenset())
    assert text("<p>a <b>b</i> c</p></div>d") == "a b c\nd"
    assert text("<ul><li>one<li>two</ul>") == "one\ntwo"
    assert text("<p title=\"a>b\">x</p><p title='open>y") == "x\ny"
    assert text("a < b <3") == "a < b <3"
    assert text("<script>if (a<b) '</p>'</script>z<!-- c") == "z"
    assert text("<div>" * 5000 + "deep") == "deep"
