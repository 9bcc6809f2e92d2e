"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap their successor. Each chunk is
pre-tokenised by itself; where a chunk and its successor both begin a pre-token
at the same place of the overlap, the two have resynchronised, and the text is
stitched there. Only places count where a plain space or line feed follows
something else: there a pre-token begins whatever stands around it, and none
before it sees beyond. Where the overlap holds none, the pieces are joined. The
pieces between two such places are encoded each by itself, in any task.

Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.bytebpe import encoder, token_table
from tallyweave.llm.common import Rows, narrow, rows_of

CHUNK, OVERLAP = 1 << 15, 1 << 11
_SPACES = " \n"
# Bytes made by a worker before it hands them out.
MOST_BYTES = 4 << 20


@lru_cache(maxsize=2)
def _table(vocabulary: str) -> list[bytes]:
    return token_table(vocabulary)


@lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _starts(pattern: regex.Pattern, text: str) -> list[int]:
    """Where pre-tokens of ``text`` begin that are fit for a stitch."""
    return [
        at
        for at in (m.start() for m in pattern.finditer(text))
        if at and text[at] in _SPACES and not text[at - 1].isspace()
    ]


def _with_bytes(column: str, name: str, make):
    """A function over batches that adds ``name``, the bytes that ``make`` gives for ``column``.

    Batches out are bounded by bytes, so a worker holds little beside the batch it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, made = 0, 0, []
            for i, (given,) in enumerate(rows_of([batch], (column,))):
                made.append(make(given))
                size += len(made[-1] or b"")
                if size >= MOST_BYTES:
                    yield _added(batch.slice(begin, len(made)), column, name, made)
                    begin, size, made = i + 1, 0, []
            yield _added(batch.slice(begin, len(made)), column, name, made)

    return run


def _added(batch: pa.RecordBatch, column: str, name: str, made: list) -> pa.RecordBatch:
    kept = {"doc_id": batch.column("doc_id")}
    if column != "text":
        kept[column] = batch.column(column)
    kept[name] = pa.array(made, pa.binary())
    return pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))


def _encode_whole(vocabulary: str, pattern: str):
    def make(text: str) -> bytes:
        ids = encoder(vocabulary, pattern).bpe.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    return _with_bytes("text", "ids", make)


def _by_chunk(columns: dict[str, pa.DataType], make):
    """A function over batches that makes rows of ``row`` and ``columns`` from each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_type = batch.column("row").type
            out = Rows(pa.schema([("row", row_type), *columns.items()]))
            names = [name for name in batch.schema.names]
            for given in rows_of([batch], names):
                for made in make(*given):
                    if out.add(made, 4 * len(made[2])):
                        yield out.batch()
            yield out.batch()

    return run


def _chunks(chunk: int, overlap: int):
    def make(row, text):
        for i, at in enumerate(range(0, len(text), chunk)):
            yield row, i, text[at : at + chunk + overlap]

    return _by_chunk({"chunk": pa.int64(), "text": pa.string()}, make)


def _pre_tokenise(pattern: str, chunk: int, overlap: int):
    """Adds the places fit for a stitch in the first and the last ``overlap`` characters."""

    def make(row, i, text):
        found = _starts(_pattern(pattern), text)
        head = [at for at in found if at < overlap]
        yield row, i, text, head, [at - chunk for at in found if at >= chunk]

    places = pa.list_(pa.int64())
    return _by_chunk(
        {"chunk": pa.int64(), "text": pa.string(), "head": places, "tail": places}, make
    )


def _encode_long(rows: DataFrame, vocabulary: str, pattern: str, chunk: int, overlap: int):
    row_type = rows.schema["row"].dataType.simpleString()
    chunks = rows.mapInArrow(
        _chunks(chunk, overlap), f"row {row_type}, chunk bigint, text string"
    ).repartition("row", "chunk")
    parts = chunks.mapInArrow(
        _pre_tokenise(pattern, chunk, overlap),
        f"row {row_type}, chunk bigint, text string, head array<bigint>, tail array<bigint>",
    )
    ordered = Window.partitionBy("row").orderBy("chunk")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(ordered)))
    stitched = (
        parts.withColumn("start", F.when(F.col("chunk") == 0, 0).otherwise(common))
        .withColumn("next", F.lead("start").over(ordered))
        .withColumn("piece", F.count("start").over(ordered))
    )
    begin = F.coalesce("start", F.lit(0))
    end = F.lit(chunk) + F.coalesce("next", F.lit(0))
    own = stitched.select(
        "row",
        "piece",
        "chunk",
        F.substring("text", (begin + 1).cast("int"), (end - begin).cast("int")).alias("text"),
    )
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda p: p["text"]),
        "",
    )
    pieces = own.groupBy("row", "piece").agg(joined.alias("text"))
    encoded = pieces.select(F.struct("row", "piece").alias("doc_id"), "text").mapInArrow(
        _encode_whole(vocabulary, pattern),
        f"doc_id struct<row: {row_type}, piece: bigint>, ids binary",
    )
    in_order = F.array_sort(F.collect_list(F.struct("doc_id.piece", "ids")))
    whole = F.aggregate(in_order, F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return encoded.groupBy("doc_id.row").agg(whole.alias("ids"))


def encode(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of every whole text.

    A text of one chunk is encoded where it is read; longer ones are dealt out
    chunk by chunk, so that no task encodes a very long text alone. Only those
    are shuffled. The result does not depend on ``chunk`` or ``overlap``.

    Null text counts as empty: no ids, an empty binary. Null and repeated ids are
    kept, one row out for each row in. Other columns are ignored.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = narrow(documents, doc_id, text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    short = rows.where(F.char_length("text") <= chunk).mapInArrow(
        _encode_whole(vocabulary, pattern), f"doc_id {id_type}, ids binary"
    )
    long = rows.where(F.char_length("text") > chunk).select(
        F.struct(F.monotonically_increasing_id().alias("place"), "doc_id").alias("row"), "text"
    )
    ids = _encode_long(long, vocabulary, pattern, chunk, overlap)
    return short.unionByName(ids.select(F.col("row.doc_id").alias("doc_id"), "ids"))


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and their ``bytes``; null ids give null bytes."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def make(ids: bytes | None) -> bytes | None:
        if ids is None:
            return None
        return b"".join(map(_table(vocabulary).__getitem__, np.frombuffer(ids, "<u4").tolist()))

    return encoded.select("doc_id", "ids").mapInArrow(
        _with_bytes("ids", "bytes", make), f"doc_id {id_type}, ids binary, bytes binary"
    )
