"""Byte-level BPE by a monoid tree reduction.

The tokens of a byte string are built from the tokens of its two halves. Two neighbours are joined
by encoding a window around their boundary again; the window grows until the tokens outside it are
proven stable. The proof uses a property of byte-pair merging: a row of tokens is the encoding of
its bytes exactly when every pair of neighbours encodes to itself. Inside each half that holds
already, so only the pairs at the two edges of the window need a look.

Decoding concatenates up the same kind of tree.

Defined results: a null or empty text has no tokens and decodes to no bytes. Long texts are split
by the vocabulary's pattern first, and a long match is reduced by the tree, so its cost does not
grow with the square of its length. Rows are independent: repeated rows repeat their result, an
empty table gives an empty one, and other columns pass through (a column with the name of the
output is replaced).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliary.llm.common import pieces, prepare, strings

#: Byte strings up to this length are merged directly; longer ones, which most long words are, are halved.
LEAF_BYTES = 8
#: Windows up to this length are merged pair by pair, longer ones from a heap.
SHORT_WINDOW = 64
#: Bytes of matches and their tokens that a worker remembers, in two generations, and pairs of tokens.
KNOWN_BYTES, KNOWN_PAIRS = 24 << 20, 100_000
#: What a remembered match takes beside its text and its packed tokens.
ENTRY_BYTES = 200
#: Stands for a pair that is no token.
NO_RANK = 1 << 62


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file: a base64 token and its rank on every line."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def explicit(pattern: str) -> str:
    r"""The pattern with \p{L}, \p{N}, \s and \S written as plain character ranges.

    The ranges stop at U+FFFF, so that the result is fast; other texts take the pattern itself.
    """

    def ranges(kind: str) -> str:
        test = regex.compile(kind).fullmatch
        codes = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and test(chr(c))]
        out, start = [], codes[0]
        for last, code in zip(codes, [*codes[1:], -1], strict=True):
            if code != last + 1:
                out.append(f"\\u{start:04x}-\\u{last:04x}")
                start = code
        return "".join(out)

    letters, numbers, space = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\p{White_Space}")
    inside = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": space}

    def plain(found: re.Match) -> str:
        text = found[0]
        if text[0] == "[":
            for name, value in inside.items():
                text = text.replace(name, value)
            return text
        return f"[^{space}]" if text == r"\S" else f"[{inside[text]}]"

    return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", plain, pattern)


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.fast = re.compile(explicit(pattern)).findall
        self.full = regex.compile(pattern).findall
        self.shown = [str(i) for i in range(max(ranks.values(), default=-1) + 1)]
        self.packed = "H" if len(self.shown) <= 1 << 16 else "I"
        self.stable: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = self.joins = 0

    def matches(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if text.isascii() or len(text.encode("utf-16-le", "replace")) == 2 * len(text):
            return self.fast(text)
        return self.full(text)

    def merge(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair has a rank."""
        if len(data) > SHORT_WINDOW:
            return self._merge_long(data)
        rank_of, none = self.ranks.get, NO_RANK
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank_of(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank_of(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = rank_of(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same merges from a heap of pairs, for windows that have grown long."""
        ranks, n = self.ranks, len(data)
        ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\x01") * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = ranks.get(data[i : ends[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ends[j] != end:
                continue
            alive[j] = 0
            ends[i], after[i] = ends[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = after[i]
        return out

    def is_stable(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens encode to themselves."""
        pair = (left, right)
        known = self.stable.get(pair)
        if known is None:
            if len(self.stable) >= KNOWN_PAIRS:
                self.stable.clear()
            known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.stable[pair] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the concatenation, given the tokens of both sides."""
        self.joins += 1
        if not left or not right or self.is_stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            head, tail = left[:-width], right[width:]
            window = left[-width:] + right[:width]
            middle = self.merge(b"".join([self.bytes_of[t] for t in window]))
            if (not head or self.is_stable(head[-1], middle[0])) and (
                not tail or self.is_stable(middle[-1], tail[0])
            ):
                return head + middle + tail
            width *= 2

    def reduce(self, data: bytes) -> list[int]:
        """Tokens of a byte string: halves first, then their join."""
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        middle = len(data) // 2
        return self.join(self.reduce(data[:middle]), self.reduce(data[middle:]))

    def encode_match(self, match: str) -> list[int]:
        data = match.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.reduce(data)

    def encode(self, text: str) -> array:
        """The tokens of a text: those of every match of the pattern, in order."""
        known, older, out = self.known, self.older, array(self.packed)
        for match in self.matches(text):
            ids = known.get(match)
            if ids is None:
                ids = older.get(match)
                if ids is None:
                    ids = array(self.packed, self.encode_match(match)).tobytes()
                if len(match) <= 64:
                    known[match] = ids
                    self.held += ENTRY_BYTES + len(match) + len(ids)
                    if self.held > KNOWN_BYTES:
                        known, older = {}, known
                        self.known, self.older, self.held = known, older, 0
            out.frombytes(ids)
        return out

    def decode(self, ids: list[int] | array) -> bytes:
        """The bytes of the tokens, joined up a tree of halves."""
        if len(ids) <= 4096:
            return b"".join([self.bytes_of[t] for t in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_codecs: dict[tuple[int, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary, built once in a worker."""
    key = (hash(ranks), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(parse_ranks(ranks), pattern)
    return _codecs[key]


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != name}
    return pa.RecordBatch.from_arrays([*columns.values(), values], names=[*columns, name])


def _encode(
    batches: Iterator[pa.RecordBatch], ranks, pattern: str, text: str, out: str
) -> Iterator[pa.RecordBatch]:
    own = codec(ranks.value, pattern)
    for batch in pieces(batches):
        offsets, flat = np.zeros(batch.num_rows + 1, np.int32), array(own.packed)
        for i, value in enumerate(strings(batch, text)):
            flat += own.encode(value)
            offsets[i + 1] = len(flat)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.asarray(flat), pa.int32()))
        yield _replaced(batch, out, ids)


def _decode(
    batches: Iterator[pa.RecordBatch], ranks, pattern: str, ids: str, out: str
) -> Iterator[pa.RecordBatch]:
    own = codec(ranks.value, pattern)
    for batch in pieces(batches):
        rows = batch.column(ids).to_pylist()
        yield _replaced(batch, out, pa.array([own.decode(x or []) for x in rows], pa.binary()))


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, text: str, out: str, path: str, pattern: str) -> DataFrame:
    """Add the column `out`: the token ids (array<int>) of the text column.

    The rank file is read here and broadcast: a vocabulary's size does not follow the data.
    """
    ranks = prepare(df.sparkSession).sparkContext.broadcast(read_ranks(path))
    job = partial(_encode, ranks=ranks, pattern=pattern, text=text, out=out)
    return df.mapInArrow(job, _with(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ids: str, out: str, path: str, pattern: str) -> DataFrame:
    """Add the column `out`: the bytes that the token ids stand for."""
    ranks = prepare(df.sparkSession).sparkContext.broadcast(read_ranks(path))
    job = partial(_decode, ranks=ranks, pattern=pattern, ids=ids, out=out)
    return df.mapInArrow(job, _with(df, out, T.BinaryType()))


def _digest(batches: Iterator[pa.RecordBatch], ranks, pattern: str, text: str) -> Iterator[pa.RecordBatch]:
    """Encode and decode every text where it is read; only counts and hashes leave the worker."""
    own = codec(ranks.value, pattern)
    for batch in pieces(batches):
        counts, coded, decoded = [], [], []
        for value in strings(batch, text):
            ids = own.encode(value)
            counts.append(len(ids))
            coded.append(hashlib.sha256(",".join([own.shown[t] for t in ids]).encode()).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
        kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != text}
        kept |= {"n_tokens": pa.array(counts, pa.int64())}
        kept |= {"ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        yield pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))


def digest(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """Encode and decode whole texts; per document the count of ids and two hashes."""
    ranks = prepare(docs.sparkSession).sparkContext.broadcast(read_ranks(path))
    base = docs.select("doc_id", *keep, "text")
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    fields = [f for f in base.schema.fields if f.name != "text"]
    fields += [T.StructField(n, T.LongType() if n == "n_tokens" else T.StringType()) for n in names]
    found = base.mapInArrow(partial(_digest, ranks=ranks, pattern=pattern, text="text"), T.StructType(fields))
    return found.select("doc_id", *names, *keep)
