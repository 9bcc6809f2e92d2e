"""Packing: concatenate and cut.

All token ids form one stream, in the order of partitions and of rows within
them. A first pass writes every document's ids with their place inside their
partition; the partition totals' prefix sums are the global offsets; a second
pass cuts the stream into windows of fixed length. A document that crosses a
window's end gives one boundary record per window it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.bytebpe import encoder
from tallyweave.llm.common import Rows, narrow, rows_of
from tallyweave.runtime import cut

_TOKENS = "part int, doc_id {id}, first bigint, n bigint, ids binary"
_PIECES = (
    "doc_id {id}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, ids binary"
)


def _fields(id_type: pa.DataType, **others: pa.DataType) -> pa.Schema:
    return pa.schema([(k, id_type if t is None else t) for k, t in others.items()])


def _tokenise(vocabulary: str, pattern: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern, added=True)
        end = np.array([end_id], encode.kind).tobytes()
        part, first, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            out = out or Rows(
                _fields(
                    batch.column("doc_id").type,
                    part=pa.int32(), doc_id=None, first=pa.int64(), n=pa.int64(), ids=pa.binary(),
                )
            )
            for doc_id, text in rows_of([batch], ("doc_id", "text")):
                ids = encode.packed(text) + end
                n = len(ids) // encode.kind.itemsize
                if out.add((part, doc_id, first, n, ids), len(ids) + 64):
                    yield out.batch()
                first += n
        if out:
            yield out.batch()

    return run


def _windows(length: int, vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out = encoder(vocabulary, pattern, added=True).kind, None
        for batch in batches:
            out = out or Rows(
                _fields(
                    batch.column("doc_id").type,
                    doc_id=None, start=pa.int64(), length=pa.int64(), doc_tokens=pa.int64(),
                    sequence_id=pa.int64(), offset=pa.int64(), ids=pa.binary(),
                )
            )
            for doc_id, first, base, packed in rows_of([batch], ("doc_id", "first", "base", "ids")):
                ids = np.frombuffer(packed, kind).astype("<u4")
                at, start, n = base + first, 0, len(ids)
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    take = min(n - start, length - offset)
                    piece = ids[start : start + take].tobytes()
                    if out.add((doc_id, start, take, n, sequence, offset, piece), 4 * take + 96):
                        yield out.batch()
                    start += take
        if out:
            yield out.batch()

    return run


def pack(
    documents: DataFrame,
    length: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    end_id: int = 0,
) -> DataFrame:
    """Pieces of the token stream, each inside one window of ``length`` ids.

    A document is its ids and then ``end_id``. One row per piece: ``doc_id``,
    ``start`` (ids of the document before it), ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (within the sequence) and ``ids`` (little-endian
    unsigned 32-bit). All sequences but the last are full.

    Null text counts as empty: one piece, the end id. A null id is kept. Repeated
    rows are packed each. An empty table gives no rows. Other columns are ignored.
    One document's ids are held in memory at a time, whatever the table.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    rows = narrow(documents, doc_id, text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    tokens = cut(
        rows.mapInArrow(_tokenise(vocabulary, pattern, end_id), _TOKENS.format(id=id_type)),
        "tokens",
    )
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per partition of the first pass, however many documents there are
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    bases = cut(totals.select("part", before.alias("base")), "bases")
    return tokens.join(bases, "part").mapInArrow(
        _windows(length, vocabulary, pattern), _PIECES.format(id=id_type)
    )


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """``sequence_id``, ``n_tokens`` and ``ids`` padded to ``length``, from the pieces.

    A sequence has at most ``length`` pieces, so a group is bounded.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    pad = F.lit(pad_id.to_bytes(4, "little") * length)
    joined = F.aggregate(
        ordered, F.lit(b""), lambda whole, piece: F.concat(whole, piece["ids"])
    )
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
        .withColumn("ids", F.substring(F.concat("ids", pad), 1, 4 * length))
    )
