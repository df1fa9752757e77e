"""Static range asymmetric numeral system over token ids, in numpy.

A block holds the ids of whole documents. ``lanes`` coder states run interleaved: lane ``k`` codes ids ``k``,
``k + lanes``, and so on, so that one numpy operation advances all lanes by one id. All blocks share one frequency table;
no block needs another to be decoded. Within a block, checkpoints hold the states and the place in the stream at every
``CHECK_STEPS`` steps, so parts of a block can be decoded alone. Checksums cover the stream and the decoded ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"QSRANS01"
#: Sum of the scaled frequencies is 2 ** BITS; states lie in [LOW, LOW << 32).
BITS, LOW = 20, np.uint64(1 << 31)
MAX_LANES, CHECK_STEPS = 2048, 256
HEAD = struct.Struct("<8sIIqqqIIII")


class Table:
    """Scaled frequencies of the ids. Ids that never occurred have none and can't be coded."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.uint32)
        if int(self.freq.sum()) != 1 << BITS:
            raise ValueError("frequencies don't add up")
        self.cum = np.concatenate([[0], np.cumsum(self.freq, dtype=np.int64)])[:-1].astype(np.uint32)
        self.crc = zlib.crc32(self.freq.tobytes())
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        return self._symbols

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Table:
        """Scale counts to 2 ** BITS; each id that occurs keeps at least 1."""
        counts = np.asarray(counts, np.int64)
        seen = np.flatnonzero(counts)
        if not len(seen):
            counts, seen = np.ones(1, np.int64), np.zeros(1, np.int64)
        if len(seen) > 1 << (BITS - 1):
            raise ValueError("too many distinct ids for the table")
        scaled = np.maximum(1, counts[seen] * ((1 << BITS) / counts.sum())).astype(np.int64)
        excess, order = int(scaled.sum()) - (1 << BITS), np.argsort(-scaled, kind="stable")
        for k in order:
            if excess == 0:
                break
            step = -excess if excess < 0 else min(excess, int(scaled[k]) // 2)
            scaled[k] += step if excess < 0 else -step
            excess += step if excess < 0 else -step
        freq = np.zeros(len(counts), np.uint32)
        freq[seen] = scaled
        return cls(freq)

    def to_bytes(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        return cls(np.frombuffer(zlib.decompress(raw), "<u4"))


def _u64(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64)


def encode_block(table: Table, ids: np.ndarray, doc_ids: list[int | None], counts: list[int], start: int) -> bytes:
    """One self-contained block: header, documents, checkpoints, stream."""
    n = len(ids)
    lanes = int(min(MAX_LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    freq, cum = table.freq, table.cum
    state, words = np.full(lanes, LOW, np.uint64), []
    checks, limit = {}, np.uint64(((1 << 31) >> BITS) << 32)
    bits, half, low32 = np.uint64(BITS), np.uint64(32), np.uint64(0xFFFFFFFF)
    for s in range(steps - 1, -1, -1):
        part = ids[s * lanes : (s + 1) * lanes]
        x = state[: len(part)]
        f = freq[part].astype(np.uint64)
        if not f.all():
            raise ValueError("an id has no frequency in the table")
        over = x >= f * limit
        words.append((x[over] & low32).astype("<u4"))
        x = np.where(over, x >> half, x)
        q = x // f
        state[: len(part)] = (q << bits) + (x - q * f) + cum[part].astype(np.uint64)
        if s % CHECK_STEPS == 0:
            checks[s] = state.copy()
    sizes = np.cumsum([0, *map(len, reversed(words))])
    stream = np.concatenate([*reversed(words), np.zeros(0, "<u4")]).astype("<u4").tobytes()
    at = sorted(checks)
    points = b"".join(struct.pack("<qq", s, int(sizes[s])) + checks[s].astype("<u8").tobytes() for s in at)
    docs = np.array([-1 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.array(counts, "<i8").tobytes()
    body = docs + points + stream
    head = HEAD.pack(MAGIC, table.crc, lanes, n, start, len(stream), len(doc_ids), len(at), zlib.crc32(np.ascontiguousarray(ids, "<u4")), zlib.crc32(body))
    return head + body


class Block:
    """A parsed block; checks the body's checksum at once and the ids' checksum when all are decoded."""

    def __init__(self, raw: bytes):
        magic, self.table_crc, self.lanes, self.n, self.start, size, docs, points, self.ids_crc, crc = HEAD.unpack_from(raw)
        if magic != MAGIC or zlib.crc32(memoryview(raw)[HEAD.size :]) != crc:
            raise ValueError("damaged block")
        at = HEAD.size
        ids = np.frombuffer(raw, "<i8", docs, at).tolist()
        null = raw[at + 8 * docs : at + 9 * docs]
        self.doc_ids = [None if z else d for d, z in zip(ids, null, strict=True)]
        self.counts = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
        at += 17 * docs
        self.points = []
        for _ in range(points):
            step, place = struct.unpack_from("<qq", raw, at)
            self.points.append((step, place, np.frombuffer(raw, "<u8", self.lanes, at + 16)))
            at += 16 + 8 * self.lanes
        self.stream = np.frombuffer(raw, "<u4", size // 4, at)

    def decode(self, table: Table, part: int | None = None) -> np.ndarray:
        """All ids, or those of one checkpoint's part."""
        if table.crc != self.table_crc:
            raise ValueError("another table was used to encode this block")
        first = 0 if part is None else part
        if not self.points:
            return np.zeros(0, np.uint32)
        step, place, state = self.points[first]
        steps = -(-self.n // self.lanes)
        end = steps if part is None or part + 1 == len(self.points) else self.points[part + 1][0]
        state, out = state.copy(), []
        bits, half, mask = np.uint64(BITS), np.uint64(32), np.uint64((1 << BITS) - 1)
        freq, cum, symbols = table.freq, table.cum, table.symbols
        for s in range(step, end):
            x = state[: min(self.lanes, self.n - s * self.lanes)]
            slot = x & mask
            sym = symbols[slot.astype(np.int64)]
            x = freq[sym].astype(np.uint64) * (x >> bits) + slot - cum[sym].astype(np.uint64)
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << half) | _u64(self.stream[place : place + len(low)])
            place += len(low)
            state[: len(x)] = x
            out.append(sym)
        ids = np.concatenate(out)
        if part is None and zlib.crc32(np.ascontiguousarray(ids, "<u4")) != self.ids_crc:
            raise ValueError("decoded ids differ from the encoded ones")
        return ids

    def documents(self, ids: np.ndarray) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of all documents before it, its ids)"""
        at = 0
        for d, c in zip(self.doc_ids, self.counts.tolist(), strict=True):
            yield d, self.start + at, ids[at : at + c]
            at += c
