"""Encoding, decoding and packing against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codec_equals_library(library):
    rng = random.Random(3)
    letters = "ab 's\n\t  é1²,.-中🙂<|> \x1c'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "x<|endoftext|>y <|endoftext|>", " " * 99 + "a", "é" * 900, "DON'T we'll 'tis", "a\r\n b"]
    tool = bpe.ForcedBoundaryCodec(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(tool.encode(text), "<u4").tolist() == want.ids
        assert tool.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    tool = bpe.ForcedBoundaryCodec(PATH)
    for text in ("one two three four five six", "six seven eight one"):
        assert np.frombuffer(tool.encode(text), "<u4").tolist() == library.encode(text).ids


def test_documents_round_trip(odd, none, library):
    rows = bpe.encode_documents(odd, PATH).collect()
    assert Counter((r[0], r["decoded"]) for r in rows) == Counter(
        (r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()
    )
    for row in rows:
        assert np.frombuffer(row["ids"], "<u4").tolist() == library.encode(row["decoded"], add_special_tokens=False).ids
    assert bpe.digests(none, PATH).collect() == []


def check_packing(pieces, docs, library):
    want = Counter()
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [packing.SEPARATOR]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    sequences = defaultdict(list)
    held = Counter()
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        held[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert held == Counter({k: v for k, v in _sizes(want).items()})
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    return sequences


def _sizes(want):
    sizes = Counter()
    for (doc_id, size, _), times in want.items():
        sizes[doc_id, size] += size * times
    return sizes


def test_packing_is_gapless_and_dense(odd, none, library):
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    pieces = packing.pack_documents(odd, PATH)
    sequences = check_packing(pieces.collect(), docs, library)
    sizes = [sum(n for _, n in parts) for parts in sequences.values()]
    assert sum(1 for s in sizes if s < packing.WINDOW) <= 1
    one = packing.padding(pieces).first()
    assert one["sequences"] == len(sizes) and one["ids"] == sum(sizes)
    assert packing.pack_documents(none, PATH).collect() == []
    assert packing.padding(packing.pack_documents(none, PATH)).first()["padding"] == 0


def test_leftovers_merge_over_many_tasks(spark, library):
    docs = [(i, "word " * (i % 90)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    pieces = packing.pack_documents(frame, PATH, open_windows=3).collect()
    sequences = check_packing(pieces, docs, library)
    assert sum(sum(n for _, n in p) < packing.WINDOW for p in sequences.values()) <= 1


def test_pieces_hold_their_ids():
    done = []
    packer = packing.Packer(done.append, window=8, open_windows=2)
    rng = random.Random(1)
    for doc in range(200):
        packer.add(doc, 0, bytes(4 * rng.randint(1, 20)), 0)
    assert all(sum(len(p[2]) for p in pieces) == 32 for pieces in done) and len(packer.open) <= 2
