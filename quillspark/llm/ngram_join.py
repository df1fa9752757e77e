"""Exact Jaccard self-join on word n-grams as a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct n-gram sets, columns the n-grams. Only columns and rows that can reach the threshold are
multiplied: a pair of sets at similarity ``t`` or more shares at least ``ceil(t / (1 + t) * (|a| + |b|))`` n-grams, so it also shares one
among the first ``n - ceil(t * n) + 1`` of each in any common order. Steps:

1. Sets of whole texts, as 64-bit hashes; equal sets are one row, known by the hash of the set and not by a doc_id, which may repeat.
2. First bound: of the first quarter or so in hash order, at least ``EXTRA`` of the set must be shared with another row. Most rows end here.
3. Remaining rows: n-grams in order of rarity; each row keeps its rarest ones up to the size bound. Unshared ones need no column.
4. Each column multiplies its rows with one of them only, that with the least unshared n-grams, as the original of many copies has; the
   accumulated overlaps give the first links and components.
5. A column whose rows all lie in one component is done. In the others, the rows outside of the column's largest component are multiplied
   with all rows of other components, but for pairs that their overlaps with the column's pivot rule out. This takes every remaining pair that can
   link, so no link that matters to a component is lost.

Overlaps are counted over whole sets. A pair is discarded before that if the larger set is too large, or if one of them shares fewer n-grams with
all other rows together than the pair's sizes ask for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import forget, ship, slices, tidy, written
from quillspark.llm.components import components

#: Share of a set that the first bound asks to be found twice, beyond what the size bound leaves out.
EXTRA = 0.1
#: Columns with more rows than this count as equally frequent, so that a run of any length streams through a task.
SATURATED = 4096
#: Bits of the filter of row ids that is sent to the tasks: a fixed 4 MB, whatever the corpus; chance hits are joined away.
FILTER_BITS = 1 << 25
#: Rows in a block of a column, on average at most.
BLOCK_ROWS = 1024
#: Words and keys of sets remembered by a worker.
WORDS, KEYS = 150_000, 1_000_000
#: A set that more than one in so many rows have is hot; there are fewer than that of them.
HOT = 1000
_GOLD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of a text: A-Z lower-cased, words between ASCII white space."""

    def __init__(self, words: int):
        self.words, self.memo = words, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.memo) > WORDS:
            self.memo.clear()
        parts = (text or "").encode().lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.memo.__getitem__, parts), np.uint64, len(parts))
        width = min(self.words, len(h))
        total = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            total = _mixed(total + h[k : len(h) - width + 1 + k] * np.uint64(_GOLD[k % 8] + 2 * (k // 8)))
        return np.unique(total)


def needed(n: int, t: float) -> int:
    """Least overlap that a set of n needs with any partner: ceil(t * n), safe against rounding."""
    return max(1, math.ceil(t * n - 1e-9))


def _key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def whole_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Re-cut a stream that is sorted by ``column`` so that no group is split; holds one group beyond a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(c != c[-1])[-1]) + 1 if (c != c[-1]).any() else 0
        if held and (cut or held[-1].column(column)[-1].as_py() != c[0]):
            head = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(head)
            held = []
            batch = batch.slice(cut)
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _sketches(docs: DataFrame, words: int, t: float) -> DataFrame:
    """doc_id, n, key (of the set) and prefix: the first n-grams in hash order that the first bound looks at; none for a set that the task has met already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, met = Shingler(words), set()
        for batch in slices(batches):
            sets = [shingle(x) for x in batch.column("text").to_pylist()]
            keys, prefix = [_key(s) for s in sets], []
            if len(met) > KEYS:
                met.clear()
            for s, k in zip(sets, keys, strict=True):
                prefix.append(s[: 0 if k in met else len(s) - needed(len(s), t) + math.ceil(EXTRA * len(s))].view(np.int64) if len(s) else s.view(np.int64))
                met.add(k)
            offsets = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate([*prefix, np.zeros(0, np.int64)]))],
                ["doc_id", "n", "key", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, key long, prefix array<long>")


def _first_bound(sketches: DataFrame, t: float) -> DataFrame:
    """key of the sets that share enough of their prefix with other sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by (h, key): an entry counts once if its h also occurs with another key
        last_h = last_key = None
        first_open = False  # the last h has had one key so far, which is not counted yet
        for batch in batches:
            if not batch.num_rows:
                continue
            h, k = batch.column("h").to_numpy(), batch.column("key").to_numpy()
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
            if last_h is not None:
                new[0] = h[0] != last_h or k[0] != last_key
            h, k = h[new], k[new]
            if not len(h):
                continue
            same_next = np.zeros(len(h), bool)
            same_next[:-1] = h[:-1] == h[1:]
            same_last = np.zeros(len(h), bool)
            same_last[1:] = same_next[:-1]
            same_last[0] = last_h is not None and h[0] == last_h
            shared = k[same_next | same_last]
            if same_last[0] and first_open:
                shared = np.append(shared, last_key)
            first_open = not (same_next | same_last)[-1]
            last_h, last_key = h[-1], k[-1]
            u, c = np.unique(shared, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(c, pa.int64())], ["key", "c"])

    entries = sketches.select("key", F.explode("prefix").alias("h"))
    shared = entries.repartition("h").sortWithinPartitions("h", "key").mapInArrow(tidy(run), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    sizes = sketches.filter("n > 0").groupBy("key").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc"))
    # prefixes that leave room for e n-grams more than the size bound share e of them; the smaller partner has t * n n-grams at least
    least = F.greatest(F.lit(1), F.ceil(EXTRA * t * F.col("n") - 1e-9))
    return shared.join(sizes, "key").filter(F.col("doc").isNotNull() & (F.col("c") >= least)).select("doc", "n", "key")


def _bits(rows: DataFrame, column: str) -> bytes:
    """A bit set for a hash of each value of ``column``: FILTER_BITS in all, whatever the number of rows."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1  # Spark's bitmaps count from 1, their buckets of 4096 bytes too
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for p in rows.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect():
        at = (p["k"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(p["bits"]), np.uint8)[:4096]
    return bits.tobytes()


def _row_sets(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """row, n, grams of the rows that are left, from a second scan that no other text leaves; row is the set's key."""
    sent = docs.sparkSession.sparkContext.broadcast(_bits(rows, "doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shingle = np.frombuffer(sent.value, np.uint8), Shingler(words)
        for batch in slices(batches):
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((held[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1))
            if not batch.num_rows:
                continue
            sets = [shingle(x).view(np.int64) for x in batch.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([_key(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(sets))], ["doc", "key", "grams"])

    source = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS)).alias("at"), "text")
    found = source.mapInArrow(tidy(run), "doc long, key long, grams array<long>")
    return found.join(rows, ["doc", "key"]).dropDuplicates(["key"]).select(F.col("key").alias("row"), "n", "grams")


def _columns(sets: DataFrame, t: float) -> DataFrame:
    """g, row, n, s: the entries of the matrix that the size bound leaves, rarest n-grams first; s is how many n-grams the row shares at all."""

    def rarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by g; runs longer than SATURATED stream on with that count
        def out(g: int, rows: list[np.ndarray], sizes: list[np.ndarray], df: int) -> pa.RecordBatch:
            r, n = np.concatenate(rows), np.concatenate(sizes)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), g), pa.int64()), pa.array(r, pa.int64()), pa.array(n, pa.int64()), pa.array(np.full(len(r), df), pa.int32())], names)

        open_g, rows, sizes, held, flowing = None, [], [], 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            g, r, n = (batch.column(c).to_numpy() for c in ("g", "row", "n"))
            starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            lengths = np.diff(starts)
            # whole runs inside the batch, all at once
            df = np.minimum(np.repeat(lengths, lengths), SATURATED)
            inner = np.ones(len(g), bool)
            inner[: starts[1]] = False
            inner[starts[-2] :] = False
            pick = inner & (df > 1)
            if pick.any():
                yield pa.RecordBatch.from_arrays([pa.array(g[pick]), pa.array(r[pick]), pa.array(n[pick]), pa.array(df[pick], pa.int32())], names)
            for a, b in dict.fromkeys(((0, int(starts[1])), (int(starts[-2]), len(g)))):
                if open_g is not None and g[a] != open_g:
                    if rows and held > 1:
                        yield out(open_g, rows, sizes, SATURATED if flowing else held)
                    rows, sizes, held, flowing = [], [], 0, False
                open_g = g[a]
                rows.append(r[a:b])
                sizes.append(n[a:b])
                held += b - a
                if held >= SATURATED:
                    flowing = True
                    yield out(open_g, rows, sizes, SATURATED)
                    rows, sizes = [], []
        if rows and held > 1:
            yield out(open_g, rows, sizes, SATURATED if flowing else held)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by (row, df, g): unshared n-grams come first in the order and use up the bound
        for table in whole_runs(batches, "row"):
            r, n = table.column("row").to_numpy(), table.column("n").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]])
            lengths = np.diff(starts)
            size = n[starts[:-1]]
            left = size - np.maximum(1, np.ceil(t * size - 1e-9)).astype(np.int64) + 1 - (size - lengths)
            place = np.arange(len(r)) - np.repeat(starts[:-1], lengths)
            table = table.select(["g", "row", "n"]).append_column("s", pa.array(np.repeat(lengths, lengths), pa.int64()))
            yield from table.filter(pa.array(place < np.repeat(left, lengths))).to_batches()

    names = ["g", "row", "n", "df"]
    entries = sets.select("row", "n", F.explode("grams").alias("g")).repartition("g").sortWithinPartitions("g")
    common = entries.mapInArrow(tidy(rarity), "g long, row long, n long, df int")
    kept = common.repartition("row").sortWithinPartitions("row", "df", "g").mapInArrow(tidy(bound), "g long, row long, n long, s long")
    return kept


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both: the number of n-grams that the rows of each pair share, counted over their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ga"):
            ga, gb = batch.column("ga"), batch.column("gb")
            both = [len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)) for x, y in zip(ga, gb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(both, pa.int64())], ["a", "b", "na", "nb", "both"])

    left = sets.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(tidy(run), "a long, b long, na long, nb long, both long")


def _possible(n: Column, s: Column, m: Column, z: Column, t: float) -> Column:
    """Whether sets of n and m n-grams, of which s and z are shared with any row, can overlap enough for a similarity of t."""
    return F.least(s, z, n, m) >= t / (1 + t) * (n + m) - 1e-6


def _open_pairs(rows: DataFrame, blocks: int, t: float) -> DataFrame:
    """a, b: all pairs of rows (g, row, n, s, c, main, pivot, o) in a common column and of different components, one of them not the column's main one.

    o is what a row shares with its column's pivot, where that was counted; it bounds what two rows can share.

    A column's rows are put into blocks, which meet the other rows as a whole; what the columns of a row bring from one block is united before
    it becomes pairs. So the rows made follow the entries and the pairs, not how often a pair meets.
    """
    block = F.pmod(F.xxhash64("row", F.lit(9)), F.lit(blocks))
    rows = rows.filter("row <> pivot")  # met all of its columns' rows before
    held = rows.groupBy("g", block.alias("k")).agg(F.collect_list(F.struct("row", "n", "s", "c", "o", (F.col("c") == F.col("main")).alias("top"))).alias("held"))
    few = rows.filter("c <> main").select("g", F.col("row").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("c").alias("ca"), F.col("o").alias("oa"))

    def fits(x: Column) -> Column:
        # what two rows share lies in the pivot, at most what each shares with it, or beside it
        most = F.least(x["o"], F.col("oa")) + F.least(x["s"] - x["o"], F.col("sa") - F.col("oa"))
        near = x["o"].isNull() | F.col("oa").isNull() | (most >= t / (1 + t) * (x["n"] + F.col("na")) - 1e-6)
        return (x["c"] != F.col("ca")) & _possible(x["n"], x["s"], F.col("na"), F.col("sa"), t) & near & (x["top"] | (x["row"] > F.col("a")))

    met = few.join(held, "g").select("a", "k", F.transform(F.filter("held", fits), lambda x: x["row"]).alias("b")).filter(F.size("b") > 0)
    met = met.groupBy("a", "k").agg(F.array_distinct(F.flatten(F.collect_list("b"))).alias("b")).select("a", F.explode("b").alias("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ngram_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their n-gram sets; texts with fewer words than ``words`` have their
    whole sequence as one n-gram. Empty, blank and null texts have no n-gram and no link. component_id is the smallest doc_id
    reachable, the row's own included. Rows without a doc_id link with nothing and have a null component; rows that repeat a doc_id
    with another text lie in the component of each of them, by the smallest one. Other columns are ignored. A task holds the words of one very long text at
    once, some 30 times its bytes.
    """
    ship(docs.sparkSession)
    t = percent / 100
    sketches = written(_sketches(docs, words, t), "ngram-sketches")
    rows = written(_first_bound(sketches, t), "ngram-rows")
    sets = written(_row_sets(docs, rows, words), "ngram-sets")
    columns = written(_columns(sets, t), "ngram-columns")

    held: list[DataFrame] = []

    def alike(pairs: DataFrame) -> DataFrame:
        held.append(written(_overlaps(pairs, sets).withColumn("linked", 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))), "ngram-overlaps"))
        return held[-1]

    first = columns.groupBy("g").agg(F.min(F.struct((1 - F.col("s") / F.col("n")).alias("alone"), "row", "n", "s")).alias("p")).select("g", F.col("p.row").alias("a"), F.col("p.n").alias("na"), F.col("p.s").alias("sa"))
    near = columns.join(first, "g").filter((F.col("a") != F.col("row")) & _possible(F.col("n"), F.col("s"), F.col("na"), F.col("sa"), t))
    pairs = near.select(F.least("a", "row").alias("a"), F.greatest("a", "row").alias("b")).distinct()
    met = alike(pairs)
    # rows that repeat a doc_id with another set join these sets: a star for each such id
    member = sketches.filter("n > 0 and doc_id is not null").select("doc_id", "n", "key")
    several = member.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a <> z").select("doc_id", "a")
    held.append(written(member.join(several, "doc_id").filter("a <> key").select("a", F.col("key").alias("b")).distinct(), "ngram-same-ids"))
    found = components(met.filter("linked").select("a", "b").union(held[-1]))

    # columns that still join several components
    labelled = written(columns.join(found, F.col("row") == F.col("node"), "left").select("g", "row", "n", "s", F.coalesce("component", "row").alias("c")), "ngram-labelled")
    parts = labelled.groupBy("g", "c").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("g").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("g", F.col("top.c").alias("main"))
    still = labelled.join(mixed, "g").join(first.select("g", F.col("a").alias("pivot")), "g").withColumns({"a": F.least("row", "pivot"), "b": F.greatest("row", "pivot")})
    still = still.join(met.select("a", "b", F.col("both").alias("o")), ["a", "b"], "left").drop("a", "b")
    pairs = _open_pairs(still, max(1, sets.count() // BLOCK_ROWS), t)
    more = alike(pairs).filter("linked").select("a", "b")
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    # a component's smallest doc_id; labels are looked up by set, and those of hot sets without a shuffle
    own = member.groupBy("key").agg(F.min("doc_id").alias("doc"), F.count("*").alias("c"))
    joined = found.join(own, F.col("node") == F.col("key")).select("node", "component", "doc")
    least = joined.groupBy("component").agg(F.min("doc").alias("least"))
    of = joined.join(least, "component").select("node", "least")
    labels = written(own.join(of, F.col("key") == F.col("node"), "left").select("key", F.coalesce("least", "doc").alias("component_id"), "c"), "ngram-labels")
    hot = F.broadcast(labels.filter(F.col("c") * HOT > sketches.count()).select("key", "component_id"))
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    rest = member.join(hot.select("key"), "key", "left_anti").join(labels.select("key", "component_id"), "key")
    out = sketches.filter(alone).select("doc_id", "n", F.col("doc_id").alias("component_id")).unionByName(member.join(hot, "key").drop("key")).unionByName(rest.drop("key"))
    forget(rows, sets, columns, labelled, *held)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, with their columns, that have the smallest doc_id of their component; rows that repeat a doc_id and text count once, null texts apart from empty ones.

    Rows without a doc_id stay. Only rows that a fixed-size filter takes for dropped or repeated ones are shuffled; the others pass as they are read.
    """
    found = written(ngram_components(docs, words, percent), "ngram-components")
    dropped = found.filter("component_id <> doc_id and n_shingles > 0").select("doc_id").distinct()
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(_bits(dropped.union(repeated), "doc_id"))
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    schema = docs.select(row, at.alias("at")).schema

    def split(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.frombuffer(sent.value, np.uint8)
            for batch in batches:
                at = batch.column("at").to_numpy()
                yield batch.filter(pa.array(((held[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1) == wanted))

        return docs.select(row, at.alias("at")).mapInArrow(tidy(run), schema)

    null = F.col("row.doc_id").isNull()
    doubtful = split(True).filter(~null).withColumn("id", F.col("row.doc_id").cast("long"))
    # a blank text links with nothing, so it stays though another text of its doc_id goes
    gone = dropped.select(F.col("doc_id").alias("gone"))
    kept = doubtful.join(gone, (F.col("id") == F.col("gone")) & F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), "left_anti").withColumns({"t": F.md5(F.coalesce("row.text", F.lit(""))), "no": F.col("row.text").isNull()}).dropDuplicates(["id", "t", "no"])
    return split(False).select("row").union(kept.select("row")).union(split(True).filter(null).select("row")).select("row.*")
