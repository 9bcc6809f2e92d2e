"""Small helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most bytes a side may have to be broadcast by hint; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 32 << 20


def text_of(name: str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def narrow(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Only ``doc_id`` and ``text`` (empty for null), so no other column can clash."""
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows stay within ``BROADCAST_BYTES``."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def rows_of(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    """The named columns of all batches, row by row."""
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names), strict=True)


class Rows:
    """Gathers rows and hands them out as batches of bounded size."""

    def __init__(self, schema: pa.Schema, most_bytes: int = 8 << 20):
        self.schema, self.most, self.held, self.bytes = schema, most_bytes, [], 0

    def add(self, row: tuple, size: int = 64) -> bool:
        """Keep the row; true once a batch is due."""
        self.held.append(row)
        self.bytes += size
        return self.bytes >= self.most

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.held, strict=True) if self.held else [()] * len(self.schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)]
        self.held, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)
