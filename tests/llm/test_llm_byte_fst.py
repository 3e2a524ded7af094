"""The transducer against the tiktoken library and against plain merging."""

import base64
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import byte_fst
from parley.llm.queries import QUERIES

PATTERN = public_tokenizers.PATTERN
NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def made(name):
    path = public_tokenizers.path(name)
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_fst.Codec(path, PATTERN), library


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    return made(request.param)


def ids_of(tool, text):
    return np.frombuffer(tool.encode(text), np.uint32).tolist()


def test_texts_equal_library(both):
    tool, library = both
    rng = random.Random(3)
    letters = "ab 's\n\t  é1²,.-中🙂<|> \x1c'tion"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "x<|endoftext|>y", " " * 99 + "a", "é" * 900, "DON'T we'll 'tis", "a\r\n b", "ab" * 3000]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(20_000))]
    for text in texts:
        ids = ids_of(tool, text)
        assert ids == library.encode_ordinary(text)
        assert tool.decode(ids) == text


TOOL, LIBRARY = made(NAMES[0])


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_library(text):
    text = text.encode("utf-8", "replace").decode()
    ids = ids_of(TOOL, text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert TOOL.decode(ids) == text


def test_borders_are_those_of_merging():
    vocabulary, rng = TOOL.vocabulary, random.Random(5)
    for _ in range(3000):
        left, right = rng.randrange(50_000), rng.randrange(3000)
        *_, (_, parts) = vocabulary.merges(vocabulary.tokens[left] + vocabulary.tokens[right])
        assert vocabulary.border(left, right) == (parts == [vocabulary.tokens[left], vocabulary.tokens[right]])


def test_forgetting_changes_nothing(monkeypatch):
    for name, size in (("MOVES", 40), ("REMEMBERED", 3)):
        monkeypatch.setattr(byte_fst, name, size)
    tool, library = made(NAMES[0])
    for text in ("one two three four five six", "six seven eight one", "incomprehensibilities" * 40):
        assert ids_of(tool, text) == library.encode_ordinary(text)


def test_tokens_are_emitted_after_bounded_lookahead():
    text, state, spelled = b"thequickbrownfoxjumpsoverthelazydog" * 50, 0, b""
    longest = max(map(len, TOOL.vocabulary.ranks))
    for place, byte in enumerate(text, 1):
        state, out = TOOL.transducer.feed(bytes([byte]), state)
        spelled += b"".join(TOOL.vocabulary.tokens[token] for token in out)
        assert place - len(spelled) <= 2 * longest
    assert spelled + b"".join(TOOL.vocabulary.tokens[t] for t in TOOL.transducer.finish(state)) == text


def test_characters_wait_for_their_bytes():
    decoder = byte_fst.StreamDecoder(TOOL.vocabulary)
    ids = [TOOL.vocabulary.ranks[bytes([b])] for b in "a🙂é".encode()]
    assert [decoder.feed([i]) for i in ids] == ["a", "", "", "", "🙂", "", "é"]
    assert decoder.finish() == ""
    for broken in (b"\xff", b"\xe4\xb8", b"\xf0\x9fa", b"\xc0\xaf", b"a\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80"):
        ids = [TOOL.vocabulary.ranks[bytes([b])] for b in broken]
        assert TOOL.decode(ids) == broken.decode("utf-8", "replace")


def test_unmergeable_ranks_are_refused(tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="lacks 255"):
        byte_fst.Vocabulary(str(tmp_path / "few"))


def test_documents_round_trip(odd, none):
    path = public_tokenizers.path(NAMES[0])
    rows = byte_fst.encode_documents(odd, path, PATTERN).collect()
    assert Counter((r[0], r["decoded"]) for r in rows) == Counter(
        (r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()
    )
    for row in rows:
        assert np.frombuffer(row["ids"], "<u4").tolist() == LIBRARY.encode_ordinary(row["decoded"])
    assert byte_fst.digests(none, path, PATTERN).collect() == []


def test_query_equals_library(spark, tables):
    rows = QUERIES["op12_byte_bpe"](spark, tables).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256(texts[row.doc_id].encode()).hexdigest()
