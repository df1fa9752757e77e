"""Token counts of whole texts from overlapping chunks, spliced at stable boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ship, slices, tidy
from quillspark.llm.tokens import CUT, default_path, encode_whole, load, widths

#: Characters from one chunk's start to the next, and by which a chunk reaches into the next one at first.
CHUNK_CHARS, OVERLAP_CHARS = 2048, 128


class Chunk:
    """Ids of ``text[start:end]`` with the bytes of the chunk at which each ends."""

    def __init__(self, text: str, start: int, end: int, ids: list[int], width: np.ndarray):
        self.text, self.start, self.end, self.ids = text, start, end, ids
        self.ends = np.cumsum(width[np.array(ids, np.int64)])

    def place(self, p: int) -> int | None:
        """The number of ids before character ``p`` of the text; None if no id begins there."""
        at = len(self.text[self.start : p].encode())
        i = int(np.searchsorted(self.ends, at, side="right"))
        return i if i < len(self.ids) and (self.ends[i - 1] if i else 0) == at else None


def splice(a: Chunk, b: Chunk, after: int) -> tuple[int, int, int] | None:
    """(place, ids of ``a`` before it, ids of ``b`` before it) of a stable boundary behind ``after`` at which both have the same id; None if there is none."""
    for m in CUT.finditer(a.text, max(b.start, after) + 1, min(a.end, b.end)):
        i, j = a.place(m.start()), b.place(m.start())
        if i is not None and j is not None and a.ids[i] == b.ids[j]:
            return m.start(), i, j
    return None


def counts(tokenizer, width: np.ndarray, texts: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The number of tokens of each text.

    Chunks start every ``chunk`` characters and reach ``overlap`` characters into the next one. Where the two share no stable boundary, the first one's
    reach is doubled until they do or the text ends; so a chunk grows only as far as its text goes on without white space.
    """

    def encoded(text: str, start: int, end: int) -> Chunk:
        return Chunk(text, start, end, encode_whole(tokenizer, [text[start:end]])[0], width)

    spans = [[(s, min(len(t), s + chunk + overlap)) for s in range(0, max(1, len(t) - overlap), chunk)] for t in texts]
    ids = iter(encode_whole(tokenizer, [t[s:e] for t, own in zip(texts, spans, strict=True) for s, e in own]))
    out = []
    for t, own in zip(texts, spans, strict=True):
        if len(own) == 1:
            out.append(len(next(ids)))
            continue
        chunks = [Chunk(t, s, e, next(ids), width) for s, e in own]
        a, total, skip, last = chunks[0], 0, 0, 0
        for b in chunks[1:]:
            reach = overlap
            while not (found := splice(a, b, last)) and a.end < len(t):
                reach *= 2
                a = encoded(t, a.start, min(len(t), b.start + reach))
                if a.end > b.end:
                    b = encoded(t, b.start, min(len(t), a.end + chunk))
            if found:
                last, i, j = found
                a, total, skip = b, total + i - skip, j
            else:  # ``a`` reaches the end of the text
                break
        out.append(total + len(a.ids) - skip)
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 512, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens; null doc_ids stay null; repeated rows are counted each; other columns are ignored. A very long text
    is encoded in chunks, never whole, but for stretches without white space, which one chunk has to hold; its time grows with its length.
    """
    ship(docs.sparkSession)
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, width = load(path), widths(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = counts(tokenizer, width, texts, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
