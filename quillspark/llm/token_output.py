"""Token-ID output: documents to entropy-coded blocks in ascending doc_id order, and back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import forget, own_dir, ship, slices, tidy, written
from quillspark.llm.rans import Block, Table, encode_block
from quillspark.llm.tokens import default_path, encoder, load

#: Ids in a block, more only where one document has more.
BLOCK_IDS = 1 << 19
#: Bytes of text in one of the ranges that are written side by side; there are as many as the texts need.
RANGE_BYTES = 64 << 20
#: Ranges whose counts one task sums up.
GROUP = 4096


def _tokenised(docs: DataFrame, path: str, end_id: int | None, range_bytes: int) -> DataFrame:
    """bucket, doc_id, n, before (ids before it in its bucket), ids (compressed), in order; buckets follow each other in order of doc_id.

    Ranges are of (doc_id, hash of the text, place in the input), so that neither a doc_id nor a row that repeats often lies in one of them alone.
    """
    size = load(path).get_vocab_size()
    dtype = "<u2" if size <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pack, total = encoder(path, dtype), zstandard.ZstdCompressor(level=1), 0
        end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
        for batch in slices(batches):
            raw = [x + end for x in known.encode(batch.column("text").to_pylist())]
            n = np.array([len(x) for x in raw]) // np.dtype(dtype).itemsize
            before, total = total + np.cumsum(n) - n, total + int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array([pack.compress(x) for x in raw], pa.binary())],
                ["bucket", "doc_id", "n", "before", "ids"],
            )

    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    order = [F.col("doc_id").asc_nulls_first(), "h", "at"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"), "text")
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("bucket"), "doc_id", "text")
    return rows.mapInArrow(tidy(encode), "bucket int, doc_id long, n long, before long, ids binary")


def _ranges(rows: DataFrame) -> DataFrame:
    """bucket, base: the ids of all buckets before it, summed up in groups of buckets and over the groups."""
    group = F.floor(F.col("bucket") / GROUP).alias("g")
    totals = rows.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", group, "n")
    inside = F.sum("n").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    groups = totals.groupBy("g").agg(F.sum("n").alias("n"))
    ahead = groups.select("g", F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"))  # a row for GROUP ranges
    zero = F.lit(0).cast("long")
    return totals.select("bucket", "g", inside.alias("inside")).join(ahead, "g").select("bucket", (F.coalesce("inside", zero) + F.coalesce("ahead", zero)).alias("base"))


def _unpack(batch: pa.RecordBatch, dtype: str) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return [np.frombuffer(unpack.decompress(x), dtype) for x in batch.column("ids").to_pylist()]


def _table(rows: DataFrame, size: int, dtype: str) -> Table:
    """The shared table, from the counts of all ids of all documents; the driver gets a row for each id of the vocabulary at most."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, "ids"):
            if batch.num_rows:
                total += np.bincount(np.concatenate(_unpack(batch, dtype)), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    found = rows.select("ids").mapInArrow(tidy(counts), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(size, np.int64)
    for r in found:
        total[r["id"]] = r["n"]
    return Table.from_counts(total)


def write_blocks(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int | None = 2, range_bytes: int = RANGE_BYTES) -> str:
    """Tokenise every row of ``docs`` (doc_id, text) and write blocks under ``path``; returns ``path``.

    ``path/blocks`` holds rows (bucket, block), ``path/ranges`` where each bucket's ids begin and ``path/table`` the frequency table, all in Spark's own
    container, so any store that Spark writes will do and a lost executor's tasks are simply run again. Documents come in ascending doc_id
    order, null doc_ids first, repeated doc_ids in order of a hash of their texts. Null and empty texts have only the end id
    (none, if ``end_id`` is None). A very long text is one row: a task holds its ids. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    tokenizer_path = tokenizer_path or default_path()
    size = load(tokenizer_path).get_vocab_size()
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    rows = written(_tokenised(docs, tokenizer_path, end_id, range_bytes), "token-ids", compression="none")
    _ranges(rows).write.parquet(f"{path}/ranges")
    raw = _table(rows, size, dtype).to_bytes()
    spark.createDataFrame([(raw,)], "freq binary").coalesce(1).write.parquet(f"{path}/table")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = Table.from_bytes(raw), [], 0

        def close() -> pa.RecordBatch:
            bucket, _, before, _ = held[0]
            block = encode_block(table, np.concatenate([x[3] for x in held]), [x[1] for x in held], [len(x[3]) for x in held], before)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.binary())], ["bucket", "block"])

        for batch in slices(batches, "ids"):
            for row in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("before").to_pylist(), _unpack(batch, dtype), strict=True):
                # a file may be read in parts and a task may read several: only rows that follow each other share a block
                if held and (n >= BLOCK_IDS or row[0] != held[-1][0] or row[2] != held[-1][2] + len(held[-1][3])):
                    yield close()
                    held, n = [], 0
                held.append(row)
                n += len(row[3])
        if held:
            yield close()

    rows.select("bucket", "doc_id", "before", "ids").mapInArrow(tidy(blocks), "bucket int, block binary").write.option("compression", "none").parquet(f"{path}/blocks")
    forget(rows)
    return path


def read_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode blocks: doc_id, start, n_tokens, ids_crc32 for each document, and ``ids`` where asked for."""
    ship(spark)
    raw = bytes(spark.read.parquet(f"{path}/table").head()["freq"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.from_bytes(raw)
        for batch in slices(batches, "block", 1):
            for bucket, block in zip(batch.column("bucket").to_pylist(), map(Block, batch.column("block").to_pylist()), strict=True):
                found = [(bucket, d, s, len(x), zlib.crc32(np.ascontiguousarray(x, "<u4")), x if with_ids else None) for d, s, x in block.documents(block.decode(table))]
                columns = list(zip(*found, strict=True))
                arrays = [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:5])]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array([x.tolist() for x in columns[5]], pa.list_(pa.int32()))] if with_ids else []), names)

    names = ["bucket", "doc_id", "before", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = "bucket int, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = spark.read.parquet(f"{path}/blocks").select("bucket", "block").mapInArrow(tidy(decode), schema)
    start = (F.col("base") + F.col("before")).alias("start")
    return found.join(spark.read.parquet(f"{path}/ranges"), "bucket").select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_output(docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Write ``docs`` as blocks and return what reading the files back gives."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{own_dir(spark)}/blocks-{uuid.uuid4().hex}"
    return read_blocks(spark, write_blocks(docs, path, tokenizer_path, end_id))
