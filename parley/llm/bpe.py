"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that never stands inside any vocabulary token can never be joined by
a merge, so the place between the two bytes is a certain cut: what lies on either side
is encoded on its own and the ids are concatenated.  Two kinds of certain cuts are
used.  Between a visible character and white space every such pair is certain (the
constructor verifies that on the vocabulary), which splits a text into fragments of
about one word.  Inside a fragment the 256 x 256 pair table gives the other cuts.

Fragments repeat, so their ids are remembered in a table of bounded size; only
fragments not met before are merged.  Time is linear in the text but for a single
stretch without any certain cut.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

#: White space as the splitting rule of the vocabulary counts it (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Fixed splitting rule of the byte-level vocabularies, white space spelled out.
PRETOKENS = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Fragments remembered per process, about 200 bytes each.
REMEMBERED = 700_000
#: After a text of more characters than this, long fragments are forgotten.
LONG = 100_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    hidden = (b for b in range(256) if b not in printable)
    letters.update({chr(256 + i): b for i, b in enumerate(hidden)})
    return letters


class ForcedBoundaryCodec:
    """Encodes and decodes with the vocabulary of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in token): number
            for token, number in stored["model"]["vocab"].items()
            if token not in special
        }
        self.special = special
        self.pattern = PRETOKENS
        self.tokens: list[bytes] = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, number in ranks.items():
            self.tokens[number] = token
        for token, number in special.items():
            self.tokens[number] = token.encode()
        self.inside = np.zeros((256, 256), bool)
        for token in ranks:
            code = np.frombuffer(token, np.uint8)
            self.inside[code[:-1], code[1:]] = True
        self._check_space_cuts()
        self._merge = tiktoken.Encoding(
            "vocabulary", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_single_piece
        self._whole = {token: np.array([n], "<u4").tobytes() for token, n in ranks.items()}
        self._pretokens = regex.compile(PRETOKENS).findall
        self._fragments = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self._specials = (
            re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        )
        self._known: dict[str, bytes] = {}

    def _check_space_cuts(self) -> None:
        """No token may hold a visible ASCII byte or a whole character before a blank."""
        visible = [b for b in range(33, 127)]
        if self.inside[np.ix_(visible, [9, 10, 11, 12, 13, 32])].any():
            raise ValueError("the vocabulary joins text across white space")

    def _pieces(self, fragment: str) -> list[bytes]:
        """Pretokens of a fragment; a plain word is one."""
        if fragment[1:].isalpha() and (fragment[0] == " " or fragment[0].isalpha()):
            return [fragment.encode()]
        return [p.encode("utf-8", "replace") for p in self._pretokens(fragment)]

    def _learn(self, fragments: list[str]) -> None:
        """Encode fragments not met before, all their cuts found in one sweep."""
        pieces = [self._pieces(f) for f in fragments]
        sizes = [len(p) for own in pieces for p in own]
        joined = b"".join([p for own in pieces for p in own])
        code = np.frombuffer(joined, np.uint8)
        certain = np.ones(len(code) + 1, bool)
        certain[1:-1] = ~self.inside[code[:-1], code[1:]]
        certain[np.cumsum(sizes)] = True
        edges = np.flatnonzero(certain).tolist()
        whole, merge, known = self._whole, self._merge, self._known
        start, number, end = 0, 0, 0
        for fragment, own in zip(fragments, pieces):
            end += sum(map(len, own))
            ids = []
            while start < end:
                number += 1
                stop = edges[number]
                part = joined[start:stop]
                ids.append(whole.get(part) or array("I", merge(part)).tobytes())
                start = stop
            known[fragment] = b"".join(ids)

    def _encode_ordinary(self, text: str) -> bytes:
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        fragments = self._fragments(text)
        out = list(map(self._known.get, fragments))
        if None in out:
            self._learn(list({f for f, ids in zip(fragments, out) if ids is None}))
            out = map(self._known.__getitem__, fragments)
        ids = b"".join(out)
        if len(text) > LONG:
            self._known = {f: i for f, i in self._known.items() if len(f) <= 64}
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; null is the empty text."""
        if not text:
            return b""
        parts = self._specials(text) if self._specials else [text]
        return b"".join(
            np.array([self.special[part]], "<u4").tobytes()
            if part in self.special
            else self._encode_ordinary(part)
            for part in parts
        )

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids, special tokens kept; broken bytes become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, ForcedBoundaryCodec] = {}


def codec(path: str) -> ForcedBoundaryCodec:
    """One codec per process and vocabulary file."""
    if path not in _codecs:
        _codecs[path] = ForcedBoundaryCodec(path)
    return _codecs[path]


ENCODED = "{key} {type}, ids binary, decoded string"


def encode_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``key``, ``ids`` (little-endian 32-bit) and the text ``decoded`` from them.

    Null texts count as empty, empty texts have no ids.  Repeated rows, null keys and an
    empty table pass through; other columns, whatever their names, are left out.  A text
    is encoded whole, however long.
    """

    def encode(batches):
        tool = codec(path)
        for batch in batches:
            ids = [tool.encode(t) for t in batch.column(1).to_pylist()]
            decoded = [tool.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                [key, "ids", "decoded"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(encode, ENCODED.format(key=f"`{key}`", type=kind))


def digests(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Digest per row of what :func:`encode_documents` gives, without moving it to the JVM.

    ``n_tokens``, ``ids_sha256`` of the decimal ids joined by commas and
    ``decoded_sha256`` of the decoded text; nulls, repeats and empty tables as there.
    """

    def encode(batches):
        tool = codec(path)
        decimal = [str(i) for i in range(len(tool.tokens))]
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column(1).to_pylist():
                ids = np.frombuffer(tool.encode(value), "<u4").tolist()
                counts.append(len(ids))
                listed = ",".join(map(decimal.__getitem__, ids))
                ids_sha.append(sha256(listed.encode()).hexdigest())
                text_sha.append(sha256(tool.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(encode, schema)
