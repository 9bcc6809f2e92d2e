"""Alignment of two tokenizers over the same bytes, by galloping intersection.

Both tokenizers cut the same bytes, a space and the text; what is compared are
the lists of byte offsets at which their tokens end. Every end of the shorter
list looks for its place in the longer one: from a guess by proportion it goes
on in doubling steps until it has passed the place, and then halves what lies
between. All ends of many texts search at once, since the texts are laid end to
end and both lists end with every text. Ends found in both lists cut the tokens
into groups. The places also tell which tokens overlap: between the places of
its start and its end lie the tokens that a token shares bytes with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.bytebpe import encoder, token_table
from tallyweave.llm.common import narrow, rows_of, small
from tallyweave.runtime import cut

# Characters of a slice of a text, and of the slices aligned at a time.
SLICE, AT_ONCE = 1 << 17, 1 << 17
_BITS = 20  # ids of both vocabularies, and slices aligned at a time, stay below 2 ** 20


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``short`` the place of the first of ``long`` that is not below it.

    Both ascend strictly; the place is ``len(long)`` where all are below.
    """
    n = len(long)
    if not n or not len(short):
        return np.zeros(len(short), np.int64)
    guess = np.arange(len(short)) * n // len(short)
    rising = long[guess] < short
    low, high = np.where(rising, guess, -1), np.where(rising, n, guess)
    going, step = np.arange(len(short)), 1
    while len(going):
        probe = guess[going] + np.where(rising[going], step, -step)
        inside = (probe >= 0) & (probe < n)
        going, probe = going[inside], probe[inside]
        below = long[probe] < short[going]
        low[going[below]], high[going[~below]] = probe[below], probe[~below]
        going = going[below == rising[going]]
        step *= 2
    wide = np.flatnonzero(high - low > 1)
    while len(wide):
        middle = (low[wide] + high[wide]) // 2
        below = long[middle] < short[wide]
        low[wide[below]], high[wide[~below]] = middle[below], middle[~below]
        wide = wide[high[wide] - low[wide] > 1]
    return high


def overlaps(ends: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token that ends at ``ends``: the first and last of the other tokens it
    shares bytes with, and whether one of them ends where it ends.

    Both lists end with the same offset.
    """
    last = gallop(ends, other)
    both = other[last] == ends
    first = np.append(0, (last + both)[:-1])
    return first, last, both


def _piece_table(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of each id."""

    def made(i: int) -> bytes:
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    return [made(i) for i in range(model.get_piece_size())]


class Aligner:
    """Both tokenizers, and the alignment of texts by them."""

    def __init__(self, vocabulary_a: str, vocabulary_b: str, pattern: str):
        self.a = encoder(vocabulary_a, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_b)
        self.bytes_a, self.bytes_b = token_table(vocabulary_a), _piece_table(self.b)
        self.sizes_a, self.sizes_b = (
            np.array([len(token) for token in table]) for table in (self.bytes_a, self.bytes_b)
        )
        names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.names = {
            end: np.array([name + end for name in names], object) for end in (",", "|", ";")
        }

    def _tokens(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each slice by both; none where one of them changes its bytes."""
        made = []
        # B puts the space before a text itself
        for part, b in zip(parts, self.b.encode([part[1:] for part in parts], num_threads=1), strict=True):
            a, given = np.frombuffer(self.a._whole(part), self.a.kind).astype(np.int64), part.encode()
            same = b"".join(map(self.bytes_b.__getitem__, b)) == given
            same = same and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == given
            made.append((a, np.array(b, np.int64)) if same else None)
        return made

    def align(self, parts: list[str]) -> list[tuple | None]:
        """For each slice: counts of tokens of both, groups and links, the groups as text
        with a semicolon after each, and its distinct links with their numbers.

        None for slices that a tokenizer changes.
        """
        tokens = self._tokens(parts)
        kept = [pair for pair in tokens if pair is not None]
        if not kept:
            return [None] * len(parts)
        a, b = (np.concatenate([pair[side] for pair in kept]) for side in (0, 1))
        until_a, until_b = (np.cumsum([len(pair[side]) for pair in kept]) for side in (0, 1))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        a_drives = len(a) <= len(b)
        driver, other = (ends_a, ends_b) if a_drives else (ends_b, ends_a)
        first, last, both = overlaps(driver, other)
        drives, driven = np.flatnonzero(both), last[both]
        at_a, at_b = (drives, driven) if a_drives else (driven, drives)

        slice_of = np.repeat(np.arange(len(kept)), np.diff(np.append(0, until_a if a_drives else until_b)))
        n = last - first + 1
        groups = np.bincount(slice_of[drives], minlength=len(kept))
        links = np.bincount(slice_of, n, len(kept)).astype(np.int64)
        begin = np.cumsum(n) - n
        reached = np.arange(n.sum()) - np.repeat(begin - first, n)
        linked = np.repeat(np.arange(len(driver)), n)
        of_a, of_b = (a[linked], b[reached]) if a_drives else (a[reached], b[linked])
        keys, times = np.unique(
            (slice_of[linked] << 2 * _BITS) | (of_a << _BITS) | of_b, return_counts=True
        )
        parts_until = np.searchsorted(keys, (np.arange(len(kept)) + 1) << 2 * _BITS)

        # a token's text goes before those of all tokens of later groups, and A's before B's
        in_a, in_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        in_a[at_a], in_b[at_b] = 1, 1
        group_a, group_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        before_b = np.append(0, at_b + 1)[group_a]
        upto_a = (at_a + 1)[group_b]
        texts = np.empty(len(a) + len(b), object)
        texts[np.arange(len(a)) + before_b] = np.where(in_a, self.names["|"][a], self.names[","][a])
        texts[np.arange(len(b)) + upto_a] = np.where(in_b, self.names[";"][b], self.names[","][b])
        texts = texts.tolist()

        made, from_a, from_b, from_key = [], 0, 0, 0
        for i in range(len(kept)):
            to_a, to_b, to_key = int(until_a[i]), int(until_b[i]), int(parts_until[i])
            made.append(
                (
                    np.array([to_a - from_a, to_b - from_b, groups[i], links[i]]),
                    "".join(texts[from_a + from_b : to_a + to_b]),
                    keys[from_key:to_key] & ((1 << 2 * _BITS) - 1),
                    times[from_key:to_key],
                )
            )
            from_a, from_b, from_key = to_a, to_b, to_key
        results = iter(made)
        return [None if pair is None else next(results) for pair in tokens]


@lru_cache(maxsize=2)
def aligner(vocabulary_a: str, vocabulary_b: str, pattern: str) -> Aligner:
    """The aligner of two vocabularies, made once per worker."""
    return Aligner(vocabulary_a, vocabulary_b, pattern)


def slices(text: str, size: int) -> Iterator[str]:
    """A space and the text in parts of about ``size`` or more characters.

    Each begins with a space that follows no white space, where both tokenizers
    begin a token whatever stands before.
    """
    whole, begin = " " + text, 0
    while begin < len(whole):
        at = whole.find(" ", begin + size)
        while at > 0 and whole[at - 1].isspace():
            at = whole.find(" ", at + 1)
        end = at if 0 < at < len(whole) - 1 else len(whole)
        yield whole[begin:end]
        begin = end


class _Text:
    """What the slices of one text add up to."""

    def __init__(self, row: tuple):
        self.row, self.fits = row, True
        self.counts, self.digest, self.open = np.zeros(4, np.int64), None, ""
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, result: tuple | None):
        if result is None:
            self.fits = False
        if not self.fits:
            return
        counts, groups, keys, times = result
        self.counts += counts
        # the semicolon after the last group of all is left out
        self.digest = self.digest or hashlib.sha256()
        self.digest.update((self.open + groups[:-1]).encode())
        self.open = groups[-1:]
        if not len(self.keys):
            self.keys, self.times = keys, times
            return
        both, of = np.unique(np.append(self.keys, keys), return_inverse=True)
        self.times = np.bincount(of, np.append(self.times, times)).astype(np.int64)
        self.keys = both


_PLACES = pa.list_(pa.int32())


def _batch(texts: list[_Text], id_type: pa.DataType) -> pa.RecordBatch:
    for text in texts:
        if not text.fits:
            text.__init__(text.row)
    sizes = np.append(0, np.cumsum([len(text.keys) for text in texts])).astype(np.int32)
    keys = np.concatenate([text.keys for text in texts])
    times = np.concatenate([text.times for text in texts])
    counts = np.array([text.counts for text in texts])

    def lists(values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(sizes), pa.array(values.astype(np.int32)))

    columns = {
        "place": pa.array([text.row[0] for text in texts], pa.int64()),
        "doc_id": pa.array([text.row[1] for text in texts], id_type),
        **{name: pa.array(counts[:, i]) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        "groups_sha256": pa.array([t.digest.hexdigest() if t.digest else "" for t in texts]),
        "a": lists(keys >> _BITS),
        "b": lists(keys & ((1 << _BITS) - 1)),
        "times": lists(times),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _align_rows(vocabulary_a: str, vocabulary_b: str, pattern: str, size: int, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(vocabulary_a, vocabulary_b, pattern)
        for batch in batches:
            id_type = batch.column("doc_id").type
            texts, held, length = [], [], 0

            def settle():
                for (owner, _), result in zip(held, both.align([part for _, part in held]), strict=True):
                    owner.add(result)
                held.clear()

            for place, doc_id, text in rows_of([batch], ("place", "doc_id", "text")):
                owner = _Text((place, doc_id))
                texts.append(owner)
                for part in slices(text, size) if text else ():
                    held.append((owner, part))
                    length += len(part)
                    if length >= at_once:
                        settle()
                        length = 0
                if not held:
                    yield _batch(texts, id_type)
                    texts = []
            settle()
            if texts:
                yield _batch(texts, id_type)

    return run


def align(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary_a: str | None = None,
    vocabulary_b: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    size: int = SLICE,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """One row per text: how the tokens of two vocabularies lie over a space and the text.

    ``n_a``, ``n_b`` tokens, ``n_groups`` between common ends, ``n_links`` pairs of
    tokens that share bytes, ``groups_sha256`` over ``a1,a2|b1;a3|b2,b3``, and the
    arrays ``a``, ``b``, ``times``: the distinct pairs of ids linked in the text and
    how often. ``place`` tells rows apart.

    Null and empty texts, and texts whose bytes a tokenizer does not give back
    (one that holds ``▁``, say), have no tokens: zeros, an empty digest, empty
    arrays. Strings of special tokens are plain text. Null and repeated ids are
    kept, other columns ignored. Long texts are aligned slice by slice, cut where
    both begin a token. Nothing is shuffled; the result is written to the shared folder.
    """
    vocabulary_a = vocabulary_a or public_tokenizers.path("byte_bpe_50k.json")
    vocabulary_b = vocabulary_b or public_tokenizers.path("piece_bpe_32k.model")
    rows = narrow(documents, doc_id, text).select(
        F.monotonically_increasing_id().alias("place"), "doc_id", "text"
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    aligned = rows.mapInArrow(
        _align_rows(vocabulary_a, vocabulary_b, pattern, size, at_once),
        f"place bigint, doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "groups_sha256 string, a array<int>, b array<int>, times array<int>",
    )
    return cut(aligned, "aligned")


def link_counts(aligned: DataFrame) -> DataFrame:
    """``a``, ``b``, the number of texts that hold the pair linked as ``count``, and whether
    it is ``best``, the highest of its ``a``, ties included. Written to the shared folder."""
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("pair")).select("pair.*")
    counted = cut(pairs.groupBy("a", "b").count(), "link-counts")
    highest = F.max("count").over(Window.partitionBy("a"))
    return cut(counted.withColumn("best", F.col("count") == highest), "best-links")


def weigh(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` without its pairs, with ``n_best`` (links whose pair is the best of its
    ``a``) and ``count_sum`` (the counts of all links)."""
    pairs = aligned.select("place", F.explode(F.arrays_zip("a", "b", "times")).alias("pair"))
    weighed = (
        pairs.select("place", "pair.*")
        .join(small(counts, 40), ["a", "b"])
        .groupBy("place")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        )
    )
    sums = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("n_best", "count_sum")}
    return aligned.drop("a", "b", "times").join(weighed, "place", "left").withColumns(sums)
