"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by a heap over linked bytes.

Cases: null text is empty and gives no ids; strings of special tokens are ordinary text;
unknown ids decode to nothing; rows repeat as often as they come; an empty table gives an
empty result.  No shuffle: every row is encoded where it is read.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import pieces

MASK = (1 << 64) - 1
# Fixed value: the pattern that cuts a text into pre-tokens before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one ``base64 rank`` per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _scatter(x: int) -> int:
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & MASK
    return x ^ (x >> 29)


def _scatter_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of byte strings by displacement: key number ``n`` of ``n`` keys, or none.

    Keys fall into buckets of four on average.  Large buckets first, each gets the least
    displacement that sends its keys to free slots of a table a little larger than the key
    set; slots beyond the key count are renumbered to the ones left free below.
    """

    def __init__(self, keys: list[bytes], load: float = 0.97):
        import xxhash

        self.n = len(keys)
        self.slots = max(int(self.n / load), self.n)
        self.buckets = max(self.n // 4, 1)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        used = np.zeros(self.slots, bool)
        displaced = np.zeros(self.buckets, np.uint64)
        place = np.zeros(self.n, np.int64)
        for b in np.argsort(-np.diff(edges), kind="stable"):
            mine = order[edges[b] : edges[b + 1]]
            if not len(mine):
                break
            for base in range(1, 1 << 40, 64):
                tries = np.arange(base, base + 64, dtype=np.uint64)
                at = (_scatter_all(hashes[mine][:, None] + tries[None, :] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.slots)).astype(np.int64)
                good = ~used[at].any(axis=0)
                if len(mine) > 1:
                    ordered = np.sort(at, axis=0)
                    good &= (ordered[1:] != ordered[:-1]).all(axis=0)
                if good.any():
                    k = int(np.argmax(good))
                    displaced[b], place[mine] = tries[k], at[:, k]
                    used[at[:, k]] = True
                    break
        free = np.flatnonzero(~used[: self.n])
        renumber = np.zeros(self.slots - self.n, np.int64)
        renumber[np.flatnonzero(used[self.n :])] = free
        self.displaced, self.renumber = displaced.tolist(), renumber.tolist()
        place = np.where(place >= self.n, renumber[np.maximum(place - self.n, 0)] if len(renumber) else place, place)
        self.keys: list[bytes] = [b""] * self.n
        self.values = np.zeros(self.n, np.int64)
        self.values[place] = np.arange(self.n)
        for i, p in enumerate(place.tolist()):
            self.keys[p] = keys[i]
        self.values = self.values.tolist()

    def find(self, key: bytes, digest) -> int:
        """Number of the key in the list given, or -1."""
        h = digest(key)
        at = _scatter(h + self.displaced[(h >> 32) % self.buckets] * 0x9E3779B97F4A7C15 & MASK) % self.slots
        if at >= self.n:
            at = self.renumber[at - self.n]
        return self.values[at] if self.keys[at] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of a piece: always join the neighbours of least rank, the leftmost of equals.

    Parts are a linked list over byte positions.  A heap holds possible joins as one integer,
    rank above position; one whose rank is no longer that of its position is skipped, so a
    piece of n bytes takes O(n log n).  ``pairs`` has the rank of each two bytes, or -1.
    """
    n = len(piece)
    shift = n.bit_length()
    mask = (1 << shift) - 1
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n))
    joint = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # rank of this part with the next, or -1
    joint.append(-1)
    joins = [rank << shift | i for i, rank in enumerate(joint) if rank >= 0]
    heapq.heapify(joins)
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    while joins:
        first = pop(joins)
        i = first & mask
        if joint[i] != first >> shift:
            continue
        j = end[i]
        stop = end[i] = end[j]
        joint[j] = rank = -1
        if stop < n:
            before[stop] = i
            rank = get(piece[i : end[stop]], -1)
            if rank >= 0:
                push(joins, rank << shift | i)
        joint[i] = rank
        p = before[i]
        if p >= 0:
            joint[p] = rank = get(piece[p:stop], -1)
            if rank >= 0:
                push(joins, rank << shift | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Tokens(dict):
    """Bytes of ids; ids that are none have none."""

    def __missing__(self, _: int) -> bytes:
        return b""


class Encoder(dict):
    """Packed ids (little-endian unsigned 32 bits) of a pre-token, by two tiers.

    Being a dict it also remembers recent pre-tokens, up to ``memory`` of them.
    """

    def __init__(self, ranks: dict[bytes, int], memory: int = 400_000):
        import regex
        import xxhash

        super().__init__()
        self.ranks, self.memory = ranks, memory
        self.pairs = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        keys = sorted(ranks, key=ranks.get)
        self.ids = [ranks[k] for k in keys]
        self.whole = PerfectHash(keys)
        self.digest = xxhash.xxh3_64_intdigest
        self.split = regex.compile(PATTERN).findall
        self.token = Tokens(zip(self.ids, keys))
        self.pack = {i: i.to_bytes(4, "little") for i in self.ids}

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        found = self.whole.find(raw, self.digest)
        ids = [self.ids[found]] if found >= 0 else merge(raw, self.ranks, self.pairs)
        packed = b"".join([self.pack[i] for i in ids])
        if len(raw) <= 64:
            if len(self) >= self.memory:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per process and file."""
    return Encoder(read_ranks(path))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``packed``: the ids as little-endian unsigned 32-bit integers.

    ``path`` is the rank file; it is read on every executor, where it must be installed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in pieces(batches, 1):
            packed = [coder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())],
                [doc_id, "n_tokens", "packed"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long, packed binary")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id") -> DataFrame:
    """``encoded`` (the output of ``encode``) with ``decoded``: the bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in pieces(batches, 2):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([coder.decode(p) for p in batch.column(2).to_pylist()], pa.binary())],
                [doc_id, "n_tokens", "packed", "decoded"],
            )

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(doc_id, "n_tokens", "packed").mapInArrow(
        run, f"`{doc_id}` {kind}, n_tokens long, packed binary, decoded binary"
    )


def ids_of(packed: Column) -> Column:
    """Packed ids as an array of integers."""
    digits = F.hex(packed)
    at = F.sequence(F.lit(1), F.length(digits), F.lit(8))
    byte = lambda i, k: F.substr(digits, i + 2 * k, F.lit(2))
    number = lambda i: F.conv(F.concat(byte(i, 3), byte(i, 2), byte(i, 1), byte(i, 0)), 16, 10).cast("long")
    return F.when(F.length(packed) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, number))
