"""Byte-level BPE by a lazily determinised finite-state transducer.

The merges, as ranks of byte strings, are compiled into a transducer.  Its paths read a
text byte by byte and guess tokens: a path stands somewhere inside a vocabulary token it
has begun (a node of the trie of all tokens) and has written the tokens before it.  It
may end a token only where merging leaves a border: the two tokens, joined and merged by
rank, must come out as the same two tokens.  Merging is local, so a text's tokens are
the one sequence in which every two neighbours pass this test, and at each place exactly one
path stands on a border.

Determinisation follows all paths at once.  A state is the set of them, each with the
tokens that it has written and the others have not yet agreed on; what all have in common
is emitted.  Two paths differ only in tokens begun within the length of one vocabulary
token, so the output lags the input by a bounded lookahead and a stream of any length
needs bounded memory.  States and moves are made when first met and remembered.

Decoding is a transducer too: its states are the bytes of a character begun, and a move
reads a token, emits the characters it completes and keeps the rest.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space as the libraries of the vocabularies count it.
SPACE = "".join(c for c in map(chr, range(0x3001)) if regex.match(r"\p{White_Space}", c))
#: Moves of the transducer kept at a time, some 300 bytes each.
MOVES = 500_000
#: Fragments of text remembered per process, some 200 bytes each, and their greatest length.
REMEMBERED, LONGEST = 800_000, 64
#: Letters of which none is another kind of character to any engine.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"

ROOT = 0
#: Rank of what never merges.
NEVER = 1 << 60
Thread = tuple[tuple[int, ...], int, int]


def own_space(pattern: str) -> str:
    r"""The pattern with ``\s`` spelled as the Unicode property, which some engines widen."""
    return pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


class Vocabulary:
    """Tokens by rank, their trie and the borders that merging leaves."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = (line.split() for line in file if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.tokens: dict[int, bytes] = {rank: token for token, rank in self.ranks.items()}
        #: node << 8 | byte -> child; nodes without children cannot be continued.
        self.children: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.inner = {ROOT}
        for token, rank in self.ranks.items():
            node = ROOT
            for byte in token:
                self.inner.add(node)
                node = self.children.setdefault(node << 8 | byte, len(self.children) + 1)
            self.ends[node] = rank
        self._borders: dict[tuple[int, int], bool] = {}
        self._outer: dict[int, tuple[list, list] | None] = {}

    def merges(self, text: bytes) -> Iterator[tuple[int, list[bytes]]]:
        """Merging by the definition, the lowest rank first, leftmost first.

        Gives the rank of every merge and the parts after it; first the single bytes.
        For tokens and pairs of tokens; it is quadratic in the length.
        """
        parts = [bytes([b]) for b in text]
        yield -1, parts
        while len(parts) > 1:
            joins = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            rank = min(joins)
            if rank == NEVER:
                return
            at = joins.index(rank)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            yield rank, parts

    def _outer_parts(self, token: int) -> tuple[list, list] | None:
        """What stands first and last in a token while it is merged, each until which rank.

        None where a merge makes a lower one possible: ranks then tell no order in time.
        """
        if token not in self._outer:
            steps = list(self.merges(self.tokens[token]))
            ranks = [rank for rank, _ in steps]
            ordered = ranks == sorted(ranks) and len(steps[-1][1]) == 1
            sides = []
            for side in (0, -1):
                shown = [[steps[0][1][side], NEVER]]
                for rank, parts in steps[1:]:
                    if parts[side] != shown[-1][0]:
                        shown[-1][1] = rank
                        shown.append([parts[side], NEVER])
                sides.append(shown)
            self._outer[token] = (sides[0], sides[1]) if ordered else None
        return self._outer[token]

    def _is_border(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses from one token into the other."""
        ahead, behind = self._outer_parts(left), self._outer_parts(right)
        if ahead is None or behind is None:
            *_, (_, parts) = self.merges(self.tokens[left] + self.tokens[right])
            return parts == [self.tokens[left], self.tokens[right]]
        lasts, firsts, i, j = ahead[1], behind[0], 0, 0
        while True:
            (x, x_until), (y, y_until) = lasts[i], firsts[j]
            rank = self.ranks.get(x + y, NEVER)
            # Of equal ranks the leftmost merges first: inside the left token, then across.
            if rank < x_until and rank <= y_until and rank != NEVER:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def border(self, left: int, right: int) -> bool:
        """Whether merging both tokens' joined bytes gives the two tokens again."""
        key = left, right
        known = self._borders.get(key)
        if known is None:
            if len(self._borders) >= MOVES:
                self._borders.clear()
            known = self._borders[key] = self._is_border(left, right)
        return known


class Transducer:
    """The determinised machine over one vocabulary; states are numbered when first met.

    State 0 is the start.  :meth:`feed` reads bytes and gives the tokens that nothing to come
    can change, :meth:`finish` the rest; :meth:`tokens` does both for a stream of any length.
    """

    SLICE = 4096

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        start: tuple[Thread, ...] = (((), -1, ROOT),)
        self._numbers: dict[tuple[Thread, ...], int] = {start: 0}
        self._states = [start]
        #: state << 8 | byte -> next state, and the tokens emitted where there are any
        self._moves: dict[int, int] = {}
        self._emits: dict[int, tuple[int, ...]] = {}

    def _number(self, threads: tuple[Thread, ...]) -> int:
        number = self._numbers.setdefault(threads, len(self._states))
        if number == len(self._states):
            self._states.append(threads)
        return number

    def _determinise(self, move: int) -> int:
        """Make the move ``state << 8 | byte``: all threads go on, at one of them a token ends."""
        vocabulary, byte, threads, borders = self.vocabulary, move & 255, [], []
        children, ends, inner = vocabulary.children, vocabulary.ends, vocabulary.inner
        for written, last, node in self._states[move >> 8]:
            child = children.get(node << 8 | byte)
            if child is None:
                continue
            token = ends.get(child)
            if token is not None and (last < 0 or vocabulary.border(last, token)):
                borders.append(((*written, token), token, ROOT))
            if child in inner:
                threads.append((written, last, child))
        if len(borders) != 1:
            raise ValueError("the ranks are not those of merges: a text has no single encoding")
        threads += borders  # from the longest begun token to none: one order for a set
        first = threads[0][0]
        agreed = len(first) if len(threads) == 1 else 0
        while agreed < len(first) and all(first[: agreed + 1] == t[0][: agreed + 1] for t in threads):
            agreed += 1
        if agreed:
            self._emits[move] = first[:agreed]
            threads = [(w[agreed:], last, node) for w, last, node in threads]
        number = self._moves[move] = self._number(tuple(threads))
        return number

    def feed(self, data: bytes, state: int = 0) -> tuple[int, list[int]]:
        """The state after ``data`` and the tokens certain by then."""
        if len(self._moves) >= MOVES:
            kept = self._states[state]
            self._forget()
            state = self._number(kept)
        moves, emits, out = self._moves, self._emits, []
        for byte in data:
            move = state << 8 | byte
            state = moves.get(move, -1)
            if state < 0:
                state = self._determinise(move)
            if move in emits:
                out += emits[move]
        return state, out

    def finish(self, state: int) -> tuple[int, ...]:
        """The tokens still held back, where the text ends."""
        return next(written for written, _, node in self._states[state] if node == ROOT)

    def tokens(self, data: bytes) -> Iterator[int]:
        """Tokens of a piece of any length, in bounded memory."""
        state = 0
        for at in range(0, len(data), self.SLICE):
            state, out = self.feed(data[at : at + self.SLICE], state)
            yield from out
        yield from self.finish(state)

    def encode(self, data: bytes) -> array:
        """All tokens of a piece."""
        if len(data) > self.SLICE:
            return array("I", self.tokens(data))
        state, out = self.feed(data)
        return array("I", [*out, *self.finish(state)])


class StreamDecoder:
    """Turns tokens into text as they come; a character begun waits for its other bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self._tokens = vocabulary.tokens
        self._moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self._pending = b""

    @staticmethod
    def _complete(data: bytes) -> int:
        """Length of ``data`` without a last character that more bytes could complete."""
        for back in range(1, min(4, len(data) + 1)):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                needs = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                return len(data) - back if needs > back else len(data)
        return len(data)

    def _move(self, token: int) -> tuple[str, bytes]:
        data = self._pending + self._tokens[token]
        end = self._complete(data)
        move = data[:end].decode("utf-8", "replace"), data[end:]
        if len(self._moves) >= MOVES:
            self._moves.clear()
        self._moves[self._pending, token] = move
        return move

    def feed(self, ids: Iterable[int]) -> str:
        """The text that these tokens complete."""
        moves, out, pending = self._moves, [], self._pending
        for token in ids:
            move = moves.get((pending, token))
            if move is None:
                self._pending = pending
                move = self._move(token)
            out.append(move[0])
            pending = move[1]
        self._pending = pending
        return "".join(out)

    def finish(self) -> str:
        """What is left of a character never completed, as U+FFFD; ready for a new stream."""
        rest, self._pending = self._pending.decode("utf-8", "replace"), b""
        return rest


class Codec:
    """Encodes whole texts: pieces by the pattern, each through the transducer.

    No piece of the pattern spans a visible character followed by white space, nor a letter
    followed by an ASCII character that is none.  A text is cut there into fragments, which
    repeat; their tokens are remembered in a table of bounded size.
    """

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.transducer = Transducer(self.vocabulary)
        self.decoder = StreamDecoder(self.vocabulary)
        self._pieces = regex.compile(own_space(pattern)).findall
        word = rf"[{SPACE}]*+[{LETTERS}]++(?=[!-@\[-`{{-~{SPACE}]|\Z)"
        self._fragments = re.compile(rf"{word}|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self._known: dict[str, bytes] = {}

    def _encoded(self, fragment: str) -> bytes:
        encode = self.transducer.encode
        return b"".join([encode(piece.encode()).tobytes() for piece in self._pieces(fragment)])

    def encode(self, text: str | None) -> bytes:
        """Ids as native unsigned 32-bit numbers."""
        if not text:
            return b""
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        known, fragments = self._known, self._fragments(text)
        parts = list(map(known.get, fragments))
        if None in parts:
            new = {f for f, part in zip(fragments, parts) if part is None}
            made = {f: self._encoded(f) for f in new}
            parts = [made[f] if part is None else part for f, part in zip(fragments, parts)]
            known.update((f, part) for f, part in made.items() if len(f) <= LONGEST)
        return b"".join(parts)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoder.feed(ids) + self.decoder.finish()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per process, vocabulary and pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``key``, ``ids`` (little-endian 32-bit) and the text ``decoded`` from them.

    Null texts count as empty, empty texts have no ids.  Repeated rows, null keys and an
    empty table pass through; other columns, whatever their names, are left out.  Texts
    are encoded whole, however long, and strings of special tokens are ordinary text.
    """

    def encode(batches):
        tool = codec(path, pattern)
        for batch in batches:
            ids = [tool.encode(value) for value in batch.column(1).to_pylist()]
            decoded = [tool.decode(np.frombuffer(i, np.uint32).tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                [key, "ids", "decoded"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids binary, decoded string")


def digests(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Digests per row of what :func:`encode_documents` gives, without moving it to the JVM.

    ``n_tokens``, ``ids_sha256`` of the decimal ids joined by one space and ``decoded_sha256``
    of the decoded bytes; nulls, repeats and empty tables as there.
    """

    def encode(batches):
        tool = codec(path, pattern)
        decimal = {rank: b"%d" % rank for rank in tool.vocabulary.tokens}
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column(1).to_pylist():
                ids = np.frombuffer(tool.encode(value), np.uint32).tolist()
                counts.append(len(ids))
                ids_sha.append(sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                decoded = tool.decode(ids)
                text_sha.append(sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(encode, schema)
