"""Document fingerprints from content-defined chunks.

A gear hash runs over the bytes of a text; a chunk ends where its value is small
enough. The bound is strict before the wanted size and loose after it (normalised
chunking), so sizes stay close together, and an edit moves only the chunk ends
around it. The fingerprint is the set of chunk digests, each with its chunk's
length; likeness is the length of the chunks that two sets share.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import Rows, narrow, rows_of

# Chunk sizes in bytes, and bits of the hash that must be zero before and after the wanted size.
LEAST, WANTED, MOST = 16, 64, 256
STRICT_BITS, LOOSE_BITS = 8, 4
_REACH = 32  # bytes that a 32-bit gear hash depends on


def _gear() -> np.ndarray:
    """A fixed pseudo-random number for each byte value."""
    with np.errstate(over="ignore"):
        x = (np.arange(256, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def gear_hashes(data: bytes) -> np.ndarray:
    """The hash after each byte: twice the last, plus the byte's number, modulo 2**32.

    Sums over the last 1, 2, 4 ... 32 bytes are built by doubling.
    """
    h = GEAR[np.frombuffer(data, np.uint8)]
    reach = 1
    while reach < min(_REACH, len(h)):
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end, the last at its length."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(data)
    loose_at = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS)))
    strict = loose_at[h[loose_at] < np.uint32(1 << (32 - STRICT_BITS))].tolist() + [n]
    loose = loose_at.tolist() + [n]
    ends, start = [], 0
    while n - start > LEAST:
        middle, last = start + WANTED, min(start + MOST, n)
        end = strict[bisect_left(strict, start + LEAST - 1)] + 1
        if end > middle:
            end = loose[bisect_left(loose, middle)] + 1
        start = min(end, last)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_set(data: bytes) -> dict[int, int]:
    """Digest (48 bits) to length of each distinct chunk."""
    start, found = 0, {}
    for end in chunk_ends(data):
        found[xxhash.xxh3_64_intdigest(data[start:end]) >> 16] = end - start
        start = end
    return found


def written(chunks: dict[int, int]) -> str:
    """The fingerprint: 12 hex digits of digest and 3 of length per chunk, in order of digest."""
    return "".join([f"{digest:012x}{size:03x}" for digest, size in sorted(chunks.items())])


def parsed(fingerprint: str) -> dict[int, int]:
    return {
        int(fingerprint[i : i + 12], 16): int(fingerprint[i + 12 : i + 15], 16)
        for i in range(0, len(fingerprint), 15)
    }


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the first's length whose chunks the second holds; 1 for two empty sets."""
    if not a:
        return float(not b)
    return sum(a[digest] for digest in a.keys() & b.keys()) / sum(a.values())


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` of every whole text, without a shuffle.

    Null text counts as empty: its fingerprint is the empty string. Equal texts
    have equal fingerprints. Null and repeated ids are kept, other columns ignored.
    """
    rows = narrow(documents, doc_id, text)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([written(chunk_set(t.encode())) for t in texts], pa.string()),
                ],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, n_chars bigint, fingerprint string")


_OUT = {
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
}


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each range followed by the first row of the next, marked as borrowed."""
    last, out = None, None
    for batch in batches:
        out = out or Rows(pa.schema([("doc_id", batch.column("doc_id").type), *_OUT.items()]))
        names = ("target", "borrowed", "doc_id", "text")
        for target, borrowed, doc_id, text in rows_of([batch], names):
            if borrowed and last is None:
                continue  # a further tie of the borrowed row
            chunks = chunk_set(text.encode())
            if last is not None:
                own_id, own, own_chunks = last
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                data = edited.encode()
                edited_chunks = chunk_set(data)
                made = (
                    own_id,
                    len(own),
                    hashlib.sha256(data).hexdigest(),
                    written(own_chunks),
                    written(edited_chunks),
                    likeness(own_chunks, edited_chunks),
                    likeness(own_chunks, chunks),
                )
                if out.add(made, 256 + len(own) // 2):
                    yield out.batch()
            last = None if borrowed else (doc_id, text, chunks)
    if out:
        yield out.batch()


def beside_next(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None
) -> DataFrame:
    """Every text's fingerprint beside those of its edited text and of the next document.

    Next is by descending ``doc_id``, the first after the last; equal ids follow
    each other by text, null ids come last. The edited text has its last half
    replaced by the first as many code points of the next one, or all. Likeness
    is the share of the document's own chunks, by length, that the other holds.

    Ids (a number type) are dealt out in ranges, so each text is shuffled once; a
    range also gets the first row of the one after it. A table of one row has
    itself as next; an empty table gives no rows. Null text counts as empty.
    Repeated rows are kept, other columns ignored. A task holds two texts at a time.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * parts
    rows = narrow(documents, doc_id, text)
    place = F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("inf"))).alias("place")
    ids = rows.select("doc_id", place)
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    found = ids.where("place < double('inf')").approxQuantile("place", shares, 0.1 / ranges)
    splits = [float("-inf"), *sorted(set(found)), float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    bucketizer = Bucketizer(splits=splits, inputCol="place", outputCol="range")
    firsts = (
        bucketizer.transform(ids).groupBy("range").agg(F.max("doc_id").alias("first")).collect()
    )  # a row per range
    firsts.sort(key=lambda row: row["range"])
    before = [(r["range"], firsts[i - 1]["range"], r["first"]) for i, r in enumerate(firsts)]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    heads = spark.createDataFrame(before, f"of double, lender_of double, first {id_type}")
    ranged = bucketizer.transform(rows.select("*", place))
    lent = F.col("doc_id").eqNullSafe(F.col("first"))
    targets = F.array(
        F.struct(F.col("range").alias("target"), F.lit(False).alias("borrowed")),
        F.when(lent, F.struct(F.col("lender_of").alias("target"), F.lit(True).alias("borrowed"))),
    )
    dealt = (
        ranged.join(F.broadcast(heads), F.col("range") == F.col("of"))
        .select("doc_id", "place", "text", F.explode(F.array_compact(targets)).alias("to"))
        .select("to.target", "to.borrowed", "doc_id", "place", "text")
        .repartition(parts, "target")
        .sortWithinPartitions("target", "borrowed", F.col("doc_id").desc_nulls_last(), "text")
    )
    return dealt.mapInArrow(
        _compare,
        f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
