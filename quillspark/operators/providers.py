"""Recognition providers: functions that turn a page into items, chosen by a column. Unknown names take the default; a page that fails is a row with its error."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship

Provider = Callable[[str], list[str]]
#: Bytes of content whose items a worker holds at a time; one page may be larger.
AT_ONCE = 1 << 20


def sliced(batch: pa.RecordBatch, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """A batch in slices, each ended by the row that brings its content to ``most`` bytes."""
    start, size = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column("content")).to_pylist()):
        size += n
        if size >= most or k + 1 == batch.num_rows:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0


@dataclass
class Registry:
    """Providers by name. A provider gets a page's content and gives its items' texts; it runs in Arrow batches on the workers."""

    default: str
    providers: dict[str, Provider] = field(default_factory=dict)

    def register(self, name: str, provider: Provider) -> None:
        if name in self.providers:
            raise ValueError(f"provider {name} is registered twice")
        self.providers[name] = provider

    def recognised(self, pages: DataFrame, page: str, provider: str, content: str) -> DataFrame:
        """page, provider (the one that ran), place, text, error: the items of every page, in order, or one row with the error of a page that failed.

        Pages of null content and pages without items have no row.
        """
        if self.default not in self.providers:
            raise ValueError(f"the default provider {self.default} is not registered")
        ship(pages.sparkSession)
        known, default = dict(self.providers), self.default
        kind = pages.schema[page].dataType.simpleString()
        rows = pages.filter(F.col(content).isNotNull()).select(F.col(page).alias("page"), F.col(provider).cast("string").alias("provider"), F.col(content).cast("string").alias("content"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in sliced(batch):
                    yield items(part)

        def items(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, used, place, text, error = [], [], [], [], []
            for k, (name, given) in enumerate(zip(batch.column("provider").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                name = name if name in known else default
                try:
                    found = [(i, str(t), None) for i, t in enumerate(known[name](given))]
                except Exception as e:  # one page's failure is its own
                    found = [(-1, None, f"{type(e).__name__}: {e}")]
                at += [k] * len(found)
                used += [name] * len(found)
                for i, t, e in found:
                    place.append(i)
                    text.append(t)
                    error.append(e)
            columns = [batch.column("page").take(pa.array(at, pa.int64())), pa.array(used, pa.string()), pa.array(place, pa.int32()), pa.array(text, pa.string()), pa.array(error, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["page", "provider", "place", "text", "error"])

        return rows.mapInArrow(run, f"page {kind}, provider string, place int, text string, error string")
