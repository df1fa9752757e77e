"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Each benchmark item gives patterns: windows of it, so close that every excerpt of half of the item holds one whole (of 9 / 8 of the longest window,
in long items). A document leaks an item if one of its patterns lies in the text within a share of the pattern's length, in single-character edits.
A pattern of m characters within k edits shares at least m + 1 - q * (k + 1) of its q-grams with its region, on diagonals that differ by k at most; so
q-grams are counted in overlapping diagonal bands, and only bands that reach that number are aligned. An item's windows are looked for in stretches, so
that what is counted and aligned does not grow with the item. Items shorter than q leak where they stand as they are, between word boundaries.

Case doesn't count, nor how long a run of white space is; of any other run of one character three count, of a run of a period of up to PERIOD
characters RUN. So rules and blanks on both sides make no more shared q-grams than words do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import ship, slices, tidy, written

#: Bytes of benchmark text that one scan looks for; a larger benchmark is split and scanned for in turn.
BLOCK_BYTES = 16 << 20
#: Case and white space are ignored. Fixed values.
_FOLD = bytes(32 if b in b"\t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes that a run of a short period may go on for, and the longest such period.
RUN, PERIOD = 24, 8
#: Alignments advanced together; shared q-grams counted at once.
TOGETHER, POSTINGS = 512, 1 << 20


def folded(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What counts of ``raw``, and the place of each of its bytes in ``raw``; bytes 0 are all kept."""
    b = np.frombuffer(raw.translate(_FOLD), np.uint8)
    same = b[1:] == b[:-1]
    keep = np.ones(len(b), bool)
    keep[1:] &= ~(same & (b[1:] == 32))
    keep[3:] &= ~(same[2:] & same[1:-1] & same[:-2]) | (b[3:] == 0)
    at = np.flatnonzero(keep)
    b = b[at]
    for period in range(2, PERIOD + 1):
        same = (b[period:] == b[:-period]) & (b[period:] != 0)
        some = same[::8]
        if (some[2:] & some[1:-1] & some[:-2]).any():  # else no run is so long
            total = np.concatenate([[0], np.cumsum(same)])
            drop = np.flatnonzero(total[RUN:] - total[:-RUN] == RUN) + RUN - 1 + period
            b, at = np.delete(b, drop), np.delete(at, drop)
    return b, at


def _grams(buf: np.ndarray, q: int) -> np.ndarray:
    """A hash of the ``q`` bytes, 16 at most, that start at each place of ``buf``; up to 8 bytes no two share one."""
    n = len(buf) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.concatenate([buf, np.zeros(16, np.uint8)]).tobytes()
    eight = np.empty((len(buf) + 7) // 8 * 8, np.uint64)
    for o in range(8):
        part = np.frombuffer(raw, "<u8", len(eight) // 8, o)
        eight[o::8] = part
    h = eight[:n] * _K1 + eight[q - 8 : n + q - 8] * _K2 if q > 8 else (eight[:n] & np.uint64((1 << 8 * q) - 1)) * _K1
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Rule:
    """q; edits for each character; bytes of a window at most, of one that may be more than ``half`` of its item, and of items looked for as a whole."""

    q: int = 8
    edits: float = 0.08
    window: int = 80
    short: int = 40
    half: float = 0.44
    whole: int = 24

    def windows(self, n: int) -> tuple[int, int, list[list[int]]]:
        """Of an item of n bytes: the bytes and edits of its patterns, and by stretches where they start."""
        size = n if n <= self.whole else max(self.whole, min(self.window, max(min(self.short, int(np.ceil(0.7 * n))), int(np.ceil(self.half * n)))))
        starts = np.array(sorted({*range(0, n - size + 1, max(1, size // 8)), n - size}))
        cuts = np.flatnonzero(np.diff(starts // size)) + 1
        return size, min(int(self.edits * size), size // self.q - 1), [part.tolist() for part in np.split(starts, cuts)]


EXCERPTS = Rule()


@dataclass
class Index:
    """Patterns and postings of some items' stretches; what a task needs, bounded by BLOCK_BYTES."""

    item_ids: list[int | None]
    items_text: list[bytes]
    rule: Rule = EXCERPTS

    def __post_init__(self):
        hashes, items, places, rows, q = [], [], [], [], self.rule.q
        self.texts, self.owner, self.short = [], [], {}
        for o, raw in enumerate(self.items_text):
            t = folded(raw.strip())[0].tobytes()
            if len(t) < q:
                if t:
                    self.short.setdefault(len(t), {}).setdefault(int(_grams(np.frombuffer(t, np.uint8), len(t))[0]), []).append(o)
                continue
            size, k, stretches = self.rule.windows(len(t))
            for starts in stretches:
                i, one = len(self.texts), t[starts[0] : starts[-1] + size]
                self.texts.append(one)
                self.owner.append(o)
                h = _grams(np.frombuffer(one, np.uint8), q)
                hashes.append(h)
                items.append(np.full(len(h), i, np.int64))
                places.append(np.arange(len(h)))
                rows += [(i, a - starts[0], size, k, size + 1 - q * (k + 1)) for a in starts]
        self.patterns = np.array(rows, np.int64).reshape(-1, 5)
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.items, self.places = np.concatenate([*items, np.zeros(0, np.int64)])[order], np.concatenate([*places, np.zeros(0, np.int64)])[order]
        self.hashes, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.least = np.full(len(self.texts), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.patterns[:, 0], self.patterns[:, 4])
        self.band = int(self.patterns[:, 3].max(initial=0)) + 1
        self.ahead = max(map(len, self.texts), default=0) + self.band  # no diagonal or band is that far below 0
        self.shift = np.uint64(64 - max(16, min(24, int(np.ceil(np.log2(len(self.hashes) + 1))) + 5)))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[(self.hashes * _K2) >> self.shift] = True
        self.own = np.searchsorted(self.patterns[:, 0], np.arange(len(self.texts) + 1))

    def bands(self, buf: np.ndarray) -> list[tuple[int, int]]:
        """(stretch, band) with enough shared q-grams; band b holds the diagonals from b * width to (b + 2) * width."""
        h = _grams(buf, self.rule.q)
        at = np.flatnonzero(self.seen[(h * _K2) >> self.shift])
        row = np.searchsorted(self.hashes, h[at])
        row[row == len(self.hashes)] = 0
        good = self.hashes[row] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        at, row = at[good], row[good]
        total = np.cumsum(self.count[row])
        keys, counts, a = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + POSTINGS, side="right")))
            n = self.count[row[a:b]]
            post = np.repeat(self.first[row[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            low = (np.repeat(at[a:b], n) - self.places[post] + self.ahead) // self.band  # diagonals may be below 0 at the start
            one, found = np.unique(self.items[post] << 40 | low, return_counts=True)
            keys += [one, one - 1]
            counts += [found, found]
            a = b
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        found = np.bincount(back, np.concatenate(counts), len(key))
        key = key[found >= self.least[key >> 40]]
        return [(int(x >> 40), int(x & ((1 << 40) - 1)) * self.band - self.ahead) for x in key]

    def exact(self, buf: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the items shorter than q, between word boundaries."""
        if not self.short:
            return
        edge = np.concatenate([[True], ~_WORD[buf], [True]])  # edge[p]: no word goes on before place p; edge[p + 1]: none at p
        for size, items in self.short.items():
            h = _grams(buf, size)
            own = np.array(sorted(items), np.uint64)
            at = np.flatnonzero(own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h)
            for p in at[edge[at] & edge[at + size + 1]].tolist():
                for o in items[int(h[p])]:
                    yield o, p, p + size

    def align(self, buf: np.ndarray, found: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(stretch, edits, start, end) of each pattern that lies in its band within its edits."""
        work = [(i, d, *p[1:4]) for i, d in found for p in self.patterns[self.own[i] : self.own[i + 1]].tolist()]
        work.sort(key=lambda w: w[3])
        for c in range(0, len(work), TOGETHER):
            part = work[c : c + TOGETHER]
            kmax, size = max(w[4] for w in part), np.array([w[3] for w in part])
            width, longest = 2 * self.band + 2 * kmax + 1, int(size.max())
            start = np.array([d + a - kmax for _, d, a, _, _ in part])
            pattern = np.zeros((len(part), longest), np.uint8)
            for r, (i, _, a, m, _) in enumerate(part):
                pattern[r, :m] = np.frombuffer(self.texts[i], np.uint8)[a : a + m]
            where = start[:, None] + np.arange(longest + width)[None, :]
            text = np.where((where >= 0) & (where < len(buf)), buf[np.clip(where, 0, max(0, len(buf) - 1))], 0)
            steps = np.arange(width, dtype=np.int32)
            cost = np.zeros((len(part), width), np.int32)
            best, at = np.full(len(part), 1 << 30), np.zeros(len(part), np.int64)
            for x in range(longest):
                new = cost + (text[:, x : x + width] != pattern[:, x : x + 1])
                new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(new - steps, axis=1) + steps
                done = np.flatnonzero(size == x + 1)
                if len(done):
                    best[done], at[done] = cost[done].min(1), cost[done].argmin(1)
            for r, (i, _, _, m, k) in enumerate(part):
                if best[r] <= k:
                    end = int(start[r] + m + at[r])
                    yield i, int(best[r]), max(0, end - m), end


def indexes(benchmark: DataFrame, rule: Rule = EXCERPTS) -> Iterator[tuple[Index, bool]]:
    """Indexes of the benchmark (item_id, text), each of at most about BLOCK_BYTES of stretches, and whether it is the last; the driver holds one and an item."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        if size >= BLOCK_BYTES:
            yield Index(ids, texts, rule), False
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"].encode())
        size += 2 * len(texts[-1])  # stretches overlap by a window
    if texts:
        yield Index(ids, texts, rule), True


def _leaks(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item, edits, start, end) with places in bytes; of several places of an item in a text the one with the least edits."""
    raws = [(t or "").encode() for t in texts]
    first = np.cumsum([0, *[len(r) + 1 for r in raws]])
    buf, at = folded(b"\0".join(raws) + b"\0")
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    found = [(index.owner[stretch], *rest) for stretch, *rest in index.align(buf, index.bands(buf))]
    for item, edits, start, end in [*found, *((o, 0, a, b) for o, a, b in index.exact(buf))]:
        start, end = int(at[max(0, start)]), int(at[min(end, len(buf)) - 1]) + 1
        n = int(np.searchsorted(first, (start + end) // 2, side="right")) - 1
        one = (edits, max(0, start - int(first[n])), min(len(raws[n]), end - int(first[n])))
        best[n, item] = min(best.get((n, item), one), one)
    for (n, item), (edits, start, end) in sorted(best.items()):
        yield n, item, edits, start, end


def _scan(docs: DataFrame, sent, run: Callable, schema, last: bool) -> DataFrame:
    """One block's pass over ``docs``. All passes but the last are written, so that neither plans nor the driver gather blocks."""
    out = docs.mapInArrow(tidy(run), schema)
    if not last:
        out = written(out, "leaks")
        sent.destroy()
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = EXCERPTS) -> DataFrame:
    """doc_id, item_id, edits, start, end: a row for each document of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it leaks by ``rule``.

    Places are code points of the region that matches one of the item's patterns best. Null and empty texts leak nothing, nor do null and blank
    items; a null doc_id is reported as null; repeated rows are reported each. Other columns are ignored. A very long text is one buffer of a task, some
    50 times its bytes; shared q-grams are counted in parts of a fixed size.
    """
    ship(docs.sparkSession)
    out, schema = None, "doc_id long, item_id long, edits int, start long, end long"
    for index, last in indexes(benchmark, rule):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in slices(batches):
                texts, rows = batch.column("text").to_pylist(), []
                ids = batch.column("doc_id").to_pylist()
                for n, item, edits, start, end in _leaks(index, texts):
                    raw = texts[n].encode()
                    rows.append((ids[n], index.item_ids[item], edits, len(raw[:start].decode(errors="ignore")), len(raw[:end].decode(errors="ignore"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "edits", "start", "end"])

        found = _scan(docs.select("doc_id", "text"), sent, run, schema, last)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, rule: Rule = EXCERPTS) -> DataFrame:
    """Rows of ``docs``, with their columns, that leak no item by ``rule``; no shuffle."""
    ship(docs.sparkSession)
    for index, last in indexes(benchmark, rule):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                bad = {n for n, *_ in _leaks(sent.value, batch.column("text").to_pylist())}
                yield batch.filter(pa.array([n not in bad for n in range(batch.num_rows)], pa.bool_()))

        docs = _scan(docs, sent, run, docs.schema, last)
    return docs
