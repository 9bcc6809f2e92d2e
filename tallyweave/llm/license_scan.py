"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Every text is covered by overlapping windows of each length class of templates,
long enough that a span that could match lies whole in one of them. That window
and the template then have at least a known Jaccard similarity, and the class has
so many bands that they share one with a probability of at least 1 - ``miss``.
Around the windows retrieved, the share of the template's shingles is counted
exactly, in windows of the template's length and in spans of up to its length
over the least share, so that inserted words, and texts that break off, match.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from types import MappingProxyType

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tallyweave.llm.common import Rows, narrow, rows_of

# Words of a shingle, share of a template that must be there, and text hashed at a time.
SHINGLE, LEAST, BATCH_BYTES = 3, 0.8, 4 << 20
# Hashes of a band, how likely a match at the threshold may be missed, and shingles hashed at a time.
BAND_ROWS, MISS, CHUNK = 2, 1e-4, 1 << 16

# The lines that the given documents hold, by license; ``notices`` has a fuller set.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "all-rights-reserved": "All rights reserved.",
}

_U, _U32 = np.uint64, np.uint32
_MARK_BITS = 14
_NONE: Mapping[str, str] = MappingProxyType({})
_REMEMBERED = 400_000
_WORD = re.compile(rb"\S+")
# Byte by byte, so that places stay: A-Z as a-z, ASCII signs and control characters as spaces.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def plain(text: str) -> bytes:
    """UTF-8 of the text with every byte in place, in lower case and without signs."""
    return text.encode().translate(_PLAIN)


def shingles(words: list[int]) -> np.ndarray:
    """Hashes of the word shingles, in order."""
    hashes = np.array(words, np.uint64)
    out = np.zeros(max(len(hashes) - SHINGLE + 1, 0), np.uint64)
    for i in range(SHINGLE):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + hashes[i : i + len(out)] + _U(i))
    return out


@dataclass(frozen=True)
class _Template:
    name: str
    shingles: np.ndarray  # sorted, distinct
    size: int  # shingles, repeated ones too
    need: int  # fewest distinct shingles that are enough
    reach: int  # shingles of the longest span


def _prepared(templates: Mapping[str, str | Sequence[str]], least: float) -> list[_Template]:
    """All wordings of the templates."""
    known, out = _Words(), []
    wordings = [
        (name, text)
        for name, given in sorted(templates.items())
        for text in ([given] if isinstance(given, str) else given)
    ]
    for name, text in wordings:
        found = shingles([known[w] for w in plain(text).split()])
        if not len(found):
            raise ValueError(f"{name}: a template has {SHINGLE} words at least")
        distinct = np.unique(found)
        need = next(n for n in range(1, len(distinct) + 1) if n / len(distinct) >= least)
        out.append(_Template(name, distinct, len(found), need, math.ceil(len(found) / least)))
    return out


def _within(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among the sorted ones."""
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def bands_for(similarity: float, miss: float, rows: int = BAND_ROWS) -> int:
    """Fewest bands of ``rows`` hashes that two sets so similar all miss with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows))) if similarity < 1 else 1


@dataclass(frozen=True)
class _Class:
    """Templates that share windows: ``blocks`` blocks of ``stride`` shingles, one from every block on."""

    stride: int
    blocks: int
    similarity: float  # least Jaccard similarity of a window that holds a match
    members: list[int]  # places in the list of templates
    keys: np.ndarray  # of each band and member
    marks: np.ndarray  # of each band, which first bits any member's key has


def _band_keys(least: np.ndarray) -> np.ndarray:
    """One value for the two minima of a band."""
    return (least[0] * _U32(0x9E3779B1) + least[1]) * _U32(0x85EBCA6B)


def _multipliers(bands: int) -> np.ndarray:
    """An odd factor for each hash: the high halves of shingles times it are the hash's values."""
    random = np.random.Generator(np.random.PCG64(29))
    return random.integers(0, 1 << 32, (bands, BAND_ROWS, 1), _U32) | _U32(1)


def _high(shingled: np.ndarray) -> np.ndarray:
    return (shingled >> _U(32)).astype(_U32)


def _classes(prepared: list[_Template], miss: float) -> list[_Class]:
    """The templates by window, those of short strides first."""
    members, similar = defaultdict(list), {}
    for i, t in enumerate(prepared):
        stride = 1 << max(t.size.bit_length() - (3 if t.size < 16 else 4), 0)
        kind = stride, -(-(t.reach + stride - 1) // stride)
        length = kind[0] * kind[1]
        members[kind].append(i)
        similar[kind] = min(similar.get(kind, 1.0), t.need / (len(t.shingles) + length - t.need))
    out = []
    for kind in sorted(members):
        factors = _multipliers(bands_for(similar[kind], miss))
        keys = np.array(
            [
                _band_keys(np.stack([(_high(prepared[i].shingles) * f).min(1) for f in factors], 1))
                for i in members[kind]
            ]
        ).T
        marks = np.zeros((len(keys), 1 << _MARK_BITS), bool)
        np.put_along_axis(marks, (keys >> _U32(32 - _MARK_BITS)).astype(np.int64), True, 1)
        out.append(_Class(*kind, similar[kind], members[kind], keys, marks))
    return out


def _retrieved(found: np.ndarray, classes: list[_Class]) -> dict[int, np.ndarray]:
    """Of each template that shares a band with a window: where such windows begin, in order."""
    if not classes:
        return {}
    top = max(c.stride for c in classes)
    beyond = -(-max(c.stride * c.blocks for c in classes) // top) * top
    all_factors = _multipliers(max(len(c.keys) for c in classes))
    starts = defaultdict(list)
    for low in range(0, len(found), CHUNK):
        n = min(CHUNK, len(found) - low)
        values = _high(found[low : low + n + beyond])
        hashed = np.full((BAND_ROWS, -(-n // top) * top + beyond), _U32(0xFFFFFFFF))
        values = values[: hashed.shape[1]]
        for band, factors in enumerate(all_factors):
            np.multiply(values, factors, out=hashed[:, : len(values)])
            level, stride, runs, width = hashed, 1, hashed, 1  # minima of blocks, and of ``width`` blocks
            for c in classes:
                if band >= len(c.keys):
                    continue
                while stride < c.stride:
                    level = np.minimum(level[:, ::2], level[:, 1::2])
                    stride, runs, width = stride * 2, level, 1
                while width * 2 <= c.blocks:
                    runs, width = np.minimum(runs[:, :-width], runs[:, width:]), width * 2
                count, rest = -(-n // stride), c.blocks - width
                keys = _band_keys(np.minimum(runs[:, :count], runs[:, rest : rest + count]))
                at = np.flatnonzero(c.marks[band][keys >> _U32(32 - _MARK_BITS)])
                for i, key in zip(c.members, c.keys[band], strict=True) if len(at) else ():
                    same = at[keys[at] == key]
                    if len(same):
                        starts[i].append(low + same * stride)
    return {i: np.unique(np.concatenate(parts)) for i, parts in starts.items()}


def _around(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Every place of windows of ``length``, and of as much on either side, once, in order."""
    low, high = np.maximum(starts - length, 0), np.minimum(starts + 2 * length, total)
    low[1:] = np.maximum(low[1:], high[:-1])
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _matches(
    found: np.ndarray, firsts: np.ndarray, prepared: list[_Template], classes: list[_Class]
) -> Iterator[tuple[int, bool, int, int, str, float, int]]:
    """(text, wide, first word, words, name, containment, shingles held) of the windows and spans that pass.

    ``found`` are the shingles of several texts in a row, ``firsts`` where each
    begins, and the end. Windows have the template's length; spans, which are
    wide, begin and end with a shingle of the template.
    """
    lengths = {i: c.stride * c.blocks for c in classes for i in c.members}
    for template, begins in sorted(_retrieved(found, classes).items()):
        t, near = prepared[template], _around(begins, lengths[template], len(found))
        places = near[_within(t.shingles, found[near])]
        held, texts = found[places], np.searchsorted(firsts, places, "right") - 1
        last = np.arange(len(places) - t.need + 1) + t.need - 1
        close = places[last] - places[: len(last)] < t.reach if len(last) else np.zeros(0, bool)
        starts: dict[int, int] = {}
        for i in np.flatnonzero(close).tolist():
            text, end = int(texts[i]), int(firsts[texts[i] + 1])
            if texts[i + t.need - 1] != text:
                continue
            low = max(int(places[i + t.need - 1]) - t.size + 1, int(firsts[text]))
            for start in range(low, min(int(places[i]), end - t.size) + 1):
                starts[start] = text
            stop = np.searchsorted(places, min(int(places[i]) + t.reach, end))
            _, new = np.unique(held[i:stop], return_index=True)
            if len(new) >= t.need:
                n = int(places[i + new.max()] - places[i]) + SHINGLE
                yield text, True, int(places[i]), n, t.name, len(new) / len(t.shingles), len(new)
        for start, text in starts.items():
            low, high = np.searchsorted(places, (start, start + t.size))
            n = len(np.unique(held[low:high]))
            if n >= t.need:
                yield text, False, start, t.size + SHINGLE - 1, t.name, n / len(t.shingles), n


def _best(
    matches: list[tuple], wide: Sequence[tuple] = (), alike: Mapping[str, str] = _NONE
) -> list[tuple]:
    """Of windows of one license, or of ``alike`` ones, that overlap, the fullest, then the first.

    The last value of a match says how full it is. A ``wide`` span counts if no window that holds it is as full, the shortest first.
    """
    wide = [
        w for w in wide
        if not any(
            m[2] == w[2] and m[-1] >= w[-1] and m[0] <= w[0] and w[0] + w[1] <= m[0] + m[1]
            for m in matches
        )
    ]
    ranked = [((-m[-1], 0, 0, m[0]), m) for m in matches]
    ranked += [((-m[-1], 1, m[1], m[0]), m) for m in wide]
    kept: list[tuple] = []
    for _, match in sorted(ranked, key=lambda r: r[0]):
        words, kind = match[1], alike.get(match[2], match[2])
        if not any(
            alike.get(k[2], k[2]) == kind and k[0] < match[0] + words and match[0] < k[0] + k[1] for k in kept
        ):
            kept.append(match)
    return sorted(kept, key=lambda m: (m[0], m[2]))


def scan(
    documents: DataFrame,
    templates: Mapping[str, str | Sequence[str]] = TEMPLATES,
    doc_id: str = "doc_id",
    text: str = "text",
    least: float = LEAST,
    alike: Mapping[str, str] | None = None,
    miss: float = MISS,
) -> DataFrame:
    """``doc_id`` and ``matches`` of every whole text: (start, end, license, containment).

    Places are code points, end exclusive. Letter case and signs do not count. A
    template is a license's wording or several. A match is a window of the template's length that holds ``least`` of its
    shingles, or a span of up to the length over ``least`` that holds as much and
    lies in no window as full; the span may be shorter than the template. Of those
    of one license that overlap, or of licenses that ``alike`` gives the same
    group, the one that holds most shingles counts, then windows, the shorter
    span, the first.

    Null text counts as empty: no matches. Null and repeated ids are kept, other
    columns ignored. Nothing is shuffled. A match that barely holds ``least`` is
    missed with a probability of ``miss`` at most, a fuller one more rarely; which
    are missed depends on the texts alone, but for what precedes them in a batch.
    """
    rows, groups = narrow(documents, doc_id, text), dict(alike or {})
    id_type = rows.schema["doc_id"].dataType.simpleString()
    span = pa.struct(
        [("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("containment", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared, known = _prepared(templates, least), _Words()
        classes = _classes(prepared, miss)

        def found_in(held: list[tuple]) -> Iterator[tuple]:
            parts = [shingles([known[w] for w in plain(raw).split()]) for _, raw in held]
            firsts = np.cumsum([0, *map(len, parts)])
            by_text = defaultdict(lambda: ([], []))
            if firsts[-1]:
                for i, wide, start, *rest in _matches(np.concatenate(parts), firsts, prepared, classes):
                    by_text[i][wide].append((start - int(firsts[i]), *rest))
            for i, (given, raw) in enumerate(held):
                out = []
                if i in by_text:
                    data = raw.encode()
                    words = [m.span() for m in _WORD.finditer(plain(raw))]
                    for first, n, name, share, _ in _best(*by_text[i], groups):
                        low, high = words[first][0], words[first + n - 1][1]
                        start = len(data[:low].decode())
                        out.append(
                            {"start": start, "end": start + len(data[low:high].decode()),
                             "license": name, "containment": share}
                        )
                yield given, out

        for batch in batches:
            schema = pa.schema([("doc_id", batch.column("doc_id").type), ("matches", pa.list_(span))])
            out, held, size = Rows(schema), [], 0
            for given, raw in rows_of([batch], ("doc_id", "text")):
                held.append((given, raw))
                size += len(raw)
                if size >= BATCH_BYTES:
                    for row in found_in(held):
                        out.add(row)
                    held, size = [], 0
            for row in found_in(held):
                out.add(row)
            yield out.batch()

    return rows.mapInArrow(
        run,
        f"doc_id {id_type}, matches array<struct<start: bigint, end: bigint, license: string, "
        "containment: double>>",
    )
