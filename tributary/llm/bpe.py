"""Byte-pair encoding of whole corpora by a lazily determinised transducer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.session import ship, spread

#: Folder of the vocabulary files of public tokenizers, unless given.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Transducer:
    """Encodes the pieces of a text, byte by byte, with bounded lookahead.

    The encoding of a prefix ends in exactly one token t, and what precedes t is the
    encoding of the shorter prefix; t fits behind the token before it iff the two encode
    to themselves together. A later token can only begin at an *open* position: one from
    which the bytes read so far are the start of some longer token. As soon as the
    encodings up to all open positions share a first part, that part is final and is emitted, so a
    state is the last emitted token and at most as many pending bytes as the longest token has.
    States and transitions are made when first met. ``words`` holds the output of whole pieces.
    """

    def __init__(self, ranks: dict[bytes, int], memo: int = 400_000):
        self.ranks, self.memo = ranks, memo
        self.prefixes = {t[:i] for t in ranks for i in range(len(t))}
        self.longest = max(map(len, ranks))
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.own: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        #: (last emitted token or -1, pending bytes) and per pending position the last token up to it or -1
        self.states: list[tuple[int, bytes, tuple[int, ...]]] = []
        self.number: dict[tuple[int, bytes], int] = {}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.start = self._state(-1, b"", (-1,))
        self.words = _Words(self)

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """The encoding by its definition: the adjacent pair of least rank merges first; only merges of ranks ``below``."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _whole(self, token: int) -> bool:
        """Whether a token's bytes encode to it."""
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def _spine(self, token: int, last: bool) -> list[tuple[int, int]]:
        """(piece, rank of the merge that ends it) of a token and its last or first pieces, down to a byte."""
        key = (token, last)
        if key not in self.spines:
            out, ends = [(token, 1 << 60)], token
            while len(text := self.bytes_of[out[-1][0]]) > 1:
                out.append((self.merge(text, ends)[-1 if last else 0], ends))
                ends = out[-1][0]
            self.spines[key] = out
        return self.spines[key]

    def _fit(self, a: int, b: int) -> bool:
        """Whether a and b side by side encode to themselves.

        They don't iff, while both are being built, some piece at the end of a and some at
        the start of b are there together and merge across before one of them merges
        inwards (of equal ranks the left merge comes first).
        """
        known = self.fits.get((a, b))
        if known is None:
            known, bytes_of, ranks = True, self.bytes_of, self.ranks
            for x, x_ends in self._spine(a, True):
                for y, y_ends in self._spine(b, False):
                    across = ranks.get(bytes_of[x] + bytes_of[y])
                    if across is not None and across < x_ends and across <= y_ends and (len(bytes_of[x]) == 1 or x < y_ends) and (len(bytes_of[y]) == 1 or y < x_ends):
                        known = False
            self.fits[a, b] = known
        return known

    def _state(self, before: int, pending: bytes, lasts: tuple[int, ...]) -> int:
        key = (before, pending)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append((before, pending, lasts))
        return self.number[key]

    def _parent(self, lasts: tuple[int, ...], at: int) -> int:
        return at - len(self.bytes_of[lasts[at]])

    def _path(self, lasts: tuple[int, ...], at: int) -> tuple[int, ...]:
        """Tokens from the pending bytes' start to a position."""
        out = []
        while at > 0:
            out.append(lasts[at])
            at = self._parent(lasts, at)
        return tuple(reversed(out))

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, pending, lasts = self.states[state]
        text = pending + bytes((byte,))
        end = len(text)
        for k in range(max(0, end - self.longest), end):
            if k and lasts[k] < 0:
                continue
            token = self.ranks.get(text[k:])
            if token is None or not self._whole(token):
                continue
            previous = lasts[k] if k else before
            if previous < 0 or self._fit(previous, token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        lasts = (*lasts, token)
        reach = [k for k in range(end + 1) if (k == 0 or lasts[k] >= 0) and text[k:] in self.prefixes]
        meet = set(reach)
        while len(meet) > 1:
            top = max(meet)
            meet.remove(top)
            meet.add(self._parent(lasts, top))
        cut = meet.pop()
        emitted = self._path(lasts, cut)
        if cut:
            alive = [-1] * (end - cut + 1)
            for k in reach:
                while k > cut:
                    alive[k - cut] = lasts[k]
                    k = self._parent(lasts, k)
            before, text, lasts = lasts[cut], text[cut:], tuple(alive)
        return self._state(before, text, lasts), emitted

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The tokens of one piece."""
        state, out = self.start, []
        for byte in data:
            key = state << 8 | byte
            move = self.moves.get(key)
            if move is None:
                move = self.moves[key] = self._move(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        if state not in self.ends:
            _, pending, lasts = self.states[state]
            self.ends[state] = self._path(lasts, len(pending))
        out += self.ends[state]
        if len(self.states) > self.memo:
            self.forget()
        return tuple(out)

    def forget(self) -> None:
        """Drop all states; they are made again as needed."""
        self.states, self.number, self.moves, self.ends = [], {}, {}, {}
        self.start = self._state(-1, b"", (-1,))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty texts. What looks like a special token is plain text."""
        if not text:
            return []
        split = SPLIT_ASCII if text.isascii() else SPLIT
        return list(chain.from_iterable(map(self.words.__getitem__, split.findall(text))))


class _Words(dict):
    """Outputs of whole pieces, run through the transducer when first met."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = self.owner.piece(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= self.owner.memo:
                self.clear()
            self[word] = out
        return out


SPLIT = regex.compile(PATTERN)
#: The same for texts of ASCII only, without Unicode classes.
SPLIT_ASCII = re.compile(PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII)
_made: dict[int, Transducer] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's tokens: per line a token in base64 and its id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def transducer(data: bytes) -> Transducer:
    """One per vocabulary and Python worker."""
    key = hash(data)
    if key not in _made:
        _made[key] = Transducer(read_ranks(data))
    return _made[key]


class Utf8Stream:
    """Decodes UTF-8 that comes in arbitrary cuts: an incremental state machine.

    Between feeds the state is the bytes of an unfinished character, three at most. Bytes
    that can't be part of a character become U+FFFD.
    """

    def __init__(self):
        self.left = b""

    def feed(self, data: bytes) -> str:
        data = self.left + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            if need > back and _may_start(data[-back:]):
                cut = len(data) - back
            break
        self.left = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.left = self.left.decode("utf-8", "replace"), b""
        return out


def _may_start(part: bytes) -> bool:
    """Whether the second byte, if there, is one that may follow the first."""
    if len(part) < 2:
        return True
    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(part[0], (0x80, 0xBF))
    return low <= part[1] <= high


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The rank file, read once by the driver and sent to the executors (under 1 MB)."""
    return spark.sparkContext.broadcast(Path(folder, f"{name}.tiktoken").read_bytes())


def encode_corpus(df: DataFrame, id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids array<int>): one row for each row, in a scan without a shuffle; null and empty texts give an empty list.

    Columns of other names play no part. Very long texts are encoded whole, a text at a time.
    """
    ship(df.sparkSession)
    ranks = vocabulary(df.sparkSession, name, folder)
    rows = spread(df.select(F.col(id).alias("id"), F.col(text).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(ranks.value).encode
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                offsets, values = [0], []
                for t in part.column(1).to_pylist():
                    values += encode(t)
                    offsets.append(len(values))
                ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(np.array(values, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    return rows.mapInArrow(work, f"id {kind}, ids array<int>")


def decode_corpus(df: DataFrame, id: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, text): the texts of lists of ids, decoded as a stream; null lists give null, ids that the vocabulary lacks U+FFFD."""
    ship(df.sparkSession)
    ranks = vocabulary(df.sparkSession, name, folder)
    rows = df.select(F.col(id).alias("id"), F.col(ids).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def text_of(values: list[int] | None, tokens: dict[int, bytes]) -> str | None:
        if values is None:
            return None
        stream, out = Utf8Stream(), []
        for s in range(0, len(values), 4096):
            out.append(stream.feed(b"".join(tokens.get(v, b"\xff") for v in values[s : s + 4096])))
        return "".join([*out, stream.close()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = transducer(ranks.value).bytes_of
        for batch in batches:
            texts = [text_of(v, tokens) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["id", "text"])

    return rows.mapInArrow(work, f"id {kind}, text string")
