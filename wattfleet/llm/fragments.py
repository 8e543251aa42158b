"""Ids of byte fragments by a bounded table: each distinct fragment is encoded once, the rest is array work.

Fragments lie in one flat buffer, as Arrow stores texts. Their 64-bit hashes come from one prefix
sum over the buffer (those of long ones from BLAKE2), and a table with open addressing gives each
hash an entry: the fragment's bytes and the place of its ids in a pool. A hit counts only if the
bytes agree; fragments that share another one's hash are encoded by themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLOTS = 1 << 21
#: Fragments that a table holds at most, and ids; beyond either it starts anew.
CACHED, POOLED = SLOTS // 2, 1 << 23
_RNG = np.random.default_rng(11)
#: A 64-bit code of every byte.
_CODES = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


#: Bytes whose hashes are made at a time, so that a very long text needs little memory; a longer fragment is by itself.
PIECE = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of the hash's step and of its inverse; kept up to PIECE of them."""
    if n > len(_powers[0]):
        made = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 4096), x, np.uint64))]) for x in (_STEP, _BACK)]
        if n > PIECE:
            return made
        _powers[:] = made
    return _powers


#: Bytes of a fragment above which its hash is BLAKE2: of longer ones a sum of powers modulo 2**64 can be made to collide.
LONG = 64


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each fragment's bytes, never 0."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        low, high = int(starts[a]), int(ends[b - 1])
        up, down = powers(high - low)
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_CODES[data[low:high]] * up[: high - low], out=sums[1:])
        out[a:b] = (sums[ends[a:b] - low] - sums[starts[a:b] - low]) * down[starts[a:b] - low]
        a = b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=b"fragments").digest(), "little")
    return out | np.uint64(1)


def heads(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each fragment as a number; of shorter ones what there is."""
    padded = np.append(data, np.zeros(8, np.uint8))
    first = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[starts]
    bits = np.minimum(size, 8).astype(np.uint64) * np.uint64(8)
    return np.where(size >= 8, first, first & ((np.uint64(1) << bits) - np.uint64(1)))


def ragged(pool: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of the pool from `first` on, of `n` entries each, one after another."""
    ends = np.cumsum(n)
    return pool[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and, for each text, where they start (and at the end where the last ends); null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` at most, so that copies of their texts stay small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def blocks(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts of some `most` bytes each."""
    out, a, n = [], 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


class FragmentTable:
    """Ids of fragments. learn: gets new fragments, returns the ids of each."""

    def __init__(self, learn: Callable[[list[bytes]], list[list[int]]], kind: np.dtype):
        self.learn, self.kind = learn, kind
        self.reset()

    def reset(self) -> None:
        self.keys, self.where = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.first, self.n, self.pool, self.size, self.used = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, self.kind), 0, 0
        # of every entry the fragment's length, its first eight bytes, and where the rest of it lies
        self.length, self.head, self.tail, self.bytes, self.bytes_used = np.zeros(1024, np.int32), np.zeros(1024, np.uint64), np.zeros(1024, np.int32), np.zeros(4096, np.uint8), 0

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash: its own, or the empty one where it would go."""
        at = (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        open_ = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (SLOTS - 1)
            k = self.keys[at[open_]]
            open_ = open_[(k != h[open_]) & (k != 0)]
        return at

    def grown(self, name: str, need: int) -> np.ndarray:
        old = getattr(self, name)
        if need > len(old):
            setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
        return getattr(self, name)

    def put(self, h: np.ndarray, ids: list[list[int]], data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        entries, total = self.size + len(ids), self.used + int(n.sum())
        rest = np.maximum(size - 8, 0)
        all_bytes = self.bytes_used + int(rest.sum())
        for name, values in (("first", self.used + np.cumsum(n) - n), ("n", n), ("length", size), ("head", heads(data, starts, size)), ("tail", self.bytes_used + np.cumsum(rest) - rest)):
            self.grown(name, entries)[self.size : entries] = values
        self.grown("pool", total)[self.used : total] = np.fromiter((i for x in ids for i in x), self.kind, total - self.used)
        self.grown("bytes", all_bytes)[self.bytes_used : all_bytes] = ragged(data, starts + 8, rest)
        todo = np.arange(len(h))
        while len(todo):  # of those that want one slot, one gets it at a time
            at = self.slots(h[todo])
            _, one = np.unique(at, return_index=True)
            self.keys[at[one]], self.where[at[one]] = h[todo[one]], self.size + todo[one]
            todo = np.delete(todo, one)
        self.size, self.used, self.bytes_used = entries, total, all_bytes

    def others(self, place: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which fragments aren't those of their entries, byte by byte."""
        differs = (self.length[place] != size) | (self.head[place] != heads(data, starts, size))
        long = np.flatnonzero((size > 8) & ~differs)
        if len(long):
            n = size[long] - 8
            wrong = ragged(self.bytes, self.tail[place[long]], n) != ragged(data, starts[long] + 8, n)
            if wrong.any():
                differs[long[np.unique(np.searchsorted(np.cumsum(n), np.flatnonzero(wrong), "right"))]] = True
        return np.flatnonzero(differs)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fragments' ids one after another, and how many each has."""
        h, size = hashes(data, starts, ends), ends - starts
        at = self.slots(h)
        lost = np.flatnonzero(self.keys[at] == 0)
        if len(lost):
            new, first = np.unique(h[lost], return_index=True)
            if self.size + len(new) > CACHED or self.used > POOLED or self.bytes_used > POOLED:
                self.reset()
                new, first = np.unique(h, return_index=True)
                lost = np.arange(len(h))
            one = lost[first]
            self.put(new, self.learned(data, starts[one], ends[one]), data, starts[one], size[one])
            at = self.slots(h)
        place = self.where[at]
        first, n, pool = self.first[place].astype(np.int64), self.n[place].astype(np.int64), self.pool
        other = self.others(place, data, starts, size)
        if len(other):
            ids = self.learned(data, starts[other], ends[other])
            n[other] = list(map(len, ids))
            first[other] = self.used + np.cumsum(n[other]) - n[other]
            pool = np.concatenate([pool[: self.used], np.fromiter((i for x in ids for i in x), self.kind, int(n[other].sum()))])
        return ragged(pool, first, n), n

    def learned(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        raw = data.tobytes()
        return self.learn([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
