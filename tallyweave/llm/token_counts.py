"""Token counts by rank-synchronous merging of arrays.

The vocabulary is that of a byte-pair model of pieces with a score each, in
which ``▁`` stands for a space. A text, with one ``▁`` before it, falls into
pre-tokens, a ``▁`` and what follows up to the next; no piece reaches over such
a border, so the pre-tokens are merged independently. Many distinct ones are
held as one ragged array of symbols. In every round each sequence finds the pair
of neighbours that ranks first in it, and all sequences merge theirs at once;
sequences without a pair left are taken out. What survives is only counted.

A sequence merges all its places of that rank in one round, from left to right
without overlap, which is the order of one merge at a time, unless a merge makes
a pair that ranks no later than itself. Ranks for which the vocabulary allows
that merge their first place only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tallyweave.llm.common import narrow, rows_of

SPACE = "▁"
# Pre-tokens a worker remembers and the longest of them; characters merged at a time.
REMEMBERED, LONGEST, AT_ONCE = 100_000, 64, 1 << 18
_NO_PAIR = np.iinfo(np.int32).max


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a vocabulary, made once per worker."""
    return Counter(path)


def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << 32 | right


class Counter:
    """Token counts of texts; ``known`` is what it remembers of pre-tokens.

    A remembered pre-token is the text after its ``▁``; its value is the number
    of tokens, negative if the ``▁`` stays a token of its own, which may still
    merge with other ``▁`` before it.
    """

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("ﬀ  x", out_type=str)[:1] != [SPACE] or model.encode(" ", out_type=str) not in (
            [SPACE * 2],
            [SPACE, SPACE],
        ):
            raise ValueError(f"{path} rewrites texts before it cuts them")
        usual = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        ]
        pieces = {model.id_to_piece(i): number for number, i in enumerate(usual)}
        scores = np.array([model.get_score(i) for i in usual])
        if any(SPACE in piece.lstrip(SPACE) for piece in pieces):
            raise ValueError(f"{path} has pieces of several words")
        blank = [piece for piece in pieces if len(piece) > 1 and not piece.strip(SPACE)]
        text = [piece for piece in pieces if len(piece) > 1 and piece.strip(SPACE)]
        if any(piece.startswith(SPACE * 2) for piece in text) or max(
            (scores[pieces[p]] for p in blank), default=-np.inf
        ) >= min(scores[pieces[p]] for p in text):
            raise ValueError(f"{path} joins spaces before words")
        self.blank = {len(piece): scores[pieces[piece]] for piece in blank}

        # equal scores rank equal; the place decides between them
        ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        splits = []
        for piece, made in pieces.items():
            for cut in range(1, len(piece)):
                left, right = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if left is not None and right is not None and piece.strip(SPACE):
                    splits.append((left, right, made))
        left, right, made = np.array(splits, np.int32).T
        order = np.argsort(_keys(left, right))
        self.pair_keys = _keys(left, right)[order]
        self.pair_made = made[order]
        self.ranks = ranks
        # ranks after which a pair may come up that ranks no later
        size = np.array([len(piece) for piece in pieces])
        first_only = np.zeros(ranks.max() + 1, bool)
        for part in (left, right):
            early = (ranks[made] <= ranks[part]) & (size[part] > 1)
            first_only[ranks[part[early]]] = True
        self.first_only = first_only
        # single characters by code point, and all neighbours that occur within a piece
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, number in pieces.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = number
        self.joined = np.unique(
            np.array([ord(a) << 32 | ord(b) for p in text for a, b in zip(p, p[1:])], np.int64)
        )

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of neighbours; ``_NO_PAIR`` where they make none."""
        keys = _keys(left, right)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        made = np.where(self.pair_keys[at] == keys, self.pair_made[at], -1)
        return np.where(made >= 0, self.ranks[made], _NO_PAIR), made

    def _merge(self, symbols: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols of each sequence survive, and the sequences whose first never merged.

        ``sequence`` numbers the sequences without gaps, in order.
        """
        total = np.bincount(sequence)
        first_alone = np.ones(len(total), bool)
        last = np.append(sequence[1:] != sequence[:-1], True)
        rank, made = self._pairs(symbols, np.append(symbols[1:], 0))
        rank[last] = _NO_PAIR
        begins = np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1]))
        while len(symbols):
            lowest = np.minimum.reduceat(rank, begins)
            lengths = np.diff(np.append(begins, len(symbols)))
            live = lowest < _NO_PAIR
            if not live.all():  # finished sequences leave
                stays = np.repeat(live, lengths)
                symbols, sequence, rank, made = (x[stays] for x in (symbols, sequence, rank, made))
                lowest, lengths = lowest[live], lengths[live]
                if not len(symbols):
                    break
                begins = np.append(0, np.cumsum(lengths)[:-1])
            hit = rank == np.repeat(lowest, lengths)
            places = np.flatnonzero(hit)
            # of hits in a row, which share symbols, every other one from the left
            new_run = np.append(True, (places[1:] != places[:-1] + 1))
            run_start = places[np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))]
            take = (places - run_start) % 2 == 0
            of = sequence[places]
            first = np.append(True, of[1:] != of[:-1])
            take &= first | ~self.first_only[rank[places]]
            places = places[take]
            at_begin = np.zeros(len(symbols), bool)
            at_begin[begins] = True
            first_alone[sequence[places[at_begin[places]]]] = False
            symbols[places] = made[places]
            kept = np.ones(len(symbols), bool)
            kept[places + 1] = False
            rank[places] = rank[places + 1]  # the end of a sequence stays its end
            total -= np.bincount(sequence[places], minlength=len(total))
            moved = places - np.arange(len(places))
            symbols, sequence, rank, made = (x[kept] for x in (symbols, sequence, rank, made))
            touched = np.zeros(len(symbols), bool)
            touched[moved] = touched[np.maximum(moved - 1, 0)] = True
            changed = np.flatnonzero(touched)
            neighbour = np.append(symbols[1:], 0)[changed]
            rank[changed], made[changed] = self._pairs(symbols[changed], neighbour)
            ends = np.append(sequence[1:] != sequence[:-1], True)
            rank[ends] = _NO_PAIR
            begins = np.flatnonzero(np.append(True, ends[:-1]))
        return total, first_alone

    def _count(self, points: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word, and whether its first symbol stays alone.

        ``points`` are code points and ``word`` the number of the word of each.
        Words fall apart where no piece holds two neighbours.
        """
        symbols = self.of_char[points]
        keys = _keys(points[:-1], points[1:])
        at = np.minimum(np.searchsorted(self.joined, keys), max(len(self.joined) - 1, 0))
        apart = (word[1:] != word[:-1]) | (self.joined[at] != keys)
        sequence = np.append(0, np.cumsum(apart))
        total, first_alone = self._merge(symbols, sequence)
        begins = np.flatnonzero(np.append(True, apart))
        # a character without a piece counts by its bytes, one of which is counted already
        rare = points[self.of_char[points] < 0]
        more = (rare >= 0x80).astype(int) + (rare >= 0x800) + (rare >= 0x10000)
        words = int(word[-1]) + 1
        tokens = np.bincount(word[begins], total, words)
        tokens += np.bincount(word[self.of_char[points] < 0], more, words)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        return tokens.astype(np.int64), first_alone[sequence[first]]

    def learn(self, words: list[str]) -> dict[str, int]:
        """What there is to remember of each of the words, which are not empty."""
        made = {}
        held, size = [], 0

        def flush():
            points = np.frombuffer("".join(SPACE + w for w in held).encode("utf-32-le"), "<u4").astype(np.int64)
            number = np.repeat(np.arange(len(held)), [len(w) + 1 for w in held])
            tokens, alone = self._count(points, number)
            made.update(zip(held, np.where(alone, -tokens, tokens).tolist(), strict=True))
            held.clear()

        for word in words:
            if len(word) > AT_ONCE:
                made[word] = self._long(word)
                continue
            held.append(word)
            size += len(word) + 1
            if size >= AT_ONCE:
                flush()
                size = 0
        if held:
            flush()
        return made

    def _long(self, word: str) -> int:
        """A very long word, part by part; each ends where no piece goes on, if it can."""
        points = np.frombuffer((SPACE + word).encode("utf-32-le"), "<u4")
        total, alone, begin, reach = 0, False, 0, AT_ONCE
        while begin < len(points):
            end = min(begin + reach, len(points))
            if end < len(points):
                keys = _keys(points[begin:end].astype(np.int64), points[begin + 1 : end + 1].astype(np.int64))
                at = np.minimum(np.searchsorted(self.joined, keys), len(self.joined) - 1)
                borders = np.flatnonzero(self.joined[at] != keys)
                if not len(borders):
                    reach *= 2
                    continue
                end = begin + int(borders[-1]) + 1
            part = points[begin:end].astype(np.int64)
            tokens, first = self._count(part, np.zeros(len(part), np.int64))
            if not begin:
                alone = bool(first[0])
            total += int(tokens[0])
            begin, reach = end, AT_ONCE
        return -total if alone else total

    @lru_cache(maxsize=4096)  # noqa: B019 (one counter lives as long as its worker)
    def _blanks_short(self, n: int) -> int:
        """Tokens that ``n`` times ``▁`` alone make, by one merge at a time."""
        size, after, before = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)]
        agenda = []

        def offer(i: int):
            j = after[i]
            if j >= 0 and size[i] + size[j] in self.blank:
                heapq.heappush(agenda, (-self.blank[size[i] + size[j]], i, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        left = n
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if size[i] != a or j < 0 or size[j] != b:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            left -= 1
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return left

    def blanks(self, n: int) -> int:
        """Tokens of a run of ``n`` times ``▁``.

        Where all pieces of spaces score alike, the left end of a run grows to the
        longest of them and is then left behind.
        """
        longest = max(self.blank, default=1)
        if n > 8 * longest and len(set(self.blank.values())) == 1:
            whole = (n - 4 * longest) // longest
            return whole + self._blanks_short(n - whole * longest)
        return self._blanks_short(n)

    def _sum(self, parts: list[str], known: dict[str, int]) -> int:
        if "" not in parts:
            return sum(map(abs, map(known.__getitem__, parts)))
        total, run = 0, 0
        for part in parts:
            run += 1  # the ▁ before the part
            if not part:
                continue
            tokens = known[part]
            if tokens < 0:
                total += -tokens - 1 + self.blanks(run)
            else:
                total += tokens + (self.blanks(run - 1) if run > 1 else 0)
            run = 0
        return total + (self.blanks(run) if run else 0)

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        found, group, size = [], [], 0
        for text in texts:
            parts = text.replace(SPACE, " ").split(" ") if text else []
            group.append(parts)
            size += len(text)
            if size >= 16 * AT_ONCE:
                found.extend(self._group(group))
                group, size = [], 0
        return found + self._group(group)

    def _group(self, group: list[list[str]]) -> list[int]:
        seen = {part for parts in group for part in parts if part}
        known = {part: self.known[part] for part in seen if part in self.known}
        learnt = self.learn([part for part in seen if part not in known])
        known |= learnt
        totals = [self._sum(parts, known) for parts in group]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known.update((w, n) for w, n in islice(learnt.items(), REMEMBERED) if len(w) <= LONGEST)
        return totals


def count_tokens(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    limit: int = 4096,
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every whole text.

    Counts are those of the vocabulary's own library without begin and end
    tokens; strings of special tokens in a text are ordinary text. Null text
    counts as empty and has no tokens. Null and repeated ids are kept, one row out
    for each row in; other columns are ignored. Nothing is shuffled; a task holds
    a batch of texts and the pre-tokens it remembers. A very long text is merged
    part by part. A vocabulary that rewrites texts or has pieces over several
    words is refused.
    """
    vocabulary = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    rows = narrow(documents, doc_id, text)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            texts = [text for (text,) in rows_of([batch], ("text",))]
            tokens = count.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(text.encode()) for text in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(
        run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
