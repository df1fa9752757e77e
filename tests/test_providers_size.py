"""Providers hold the items of a slice at a time."""

import pyarrow as pa

from quillspark.operators.providers import sliced


def test_slices_are_bounded_and_whole():
    texts = ["x" * n for n in (5, 0, 9, 30, 2, 2, 2, 2, 2, 2, 1)]
    batch = pa.RecordBatch.from_pydict({"page": list(range(len(texts))), "content": texts})
    parts = list(sliced(batch, 10))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(sum(map(len, p.column("content").to_pylist()[:-1])) < 10 for p in parts) and len(parts) == 4
    assert list(sliced(batch.slice(0, 0))) == []
