"""Secret scans in DataFrame functions only: named patterns, and entropy in sliding windows.

A pattern's spans come from splitting the text at its matches: a match begins
where the pieces and matches before it end. Candidates for the entropy test are
runs of token characters. Over each slides a window of fixed length whose
Shannon entropy follows from counts that lose one character and gain one; what
counts as high depends on the class of characters the run is made of.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import text_of

# The three patterns, the group that must be long enough, and how long.
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# These two match whole runs, so that asking for the length at once gives the same spans.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
# A text without a match of these has no span of the kind; they only save the work of splitting.
_MAY_HOLD = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}

CANDIDATE = r"[A-Za-z0-9+/_=-]"
_NAMES = (*(kind for kind, *_ in KINDS), "entropy")
_SPAN = "array<struct<start: bigint, rank: int, end: bigint>>"


@dataclass(frozen=True)
class EntropyRules:
    """Settings of the entropy test; bits are per character of a window.

    A run is suppressed if a pattern of ``allow`` matches anywhere in it, or if
    it lacks a digit or a letter (words, paths, and numbers such as card numbers).
    """

    window: int = 20
    hex_bits: float = 3.0
    lower_bits: float = 3.6
    mixed_bits: float = 3.8
    allow: tuple[str, ...] = field(
        default=(
            r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",  # UUID
            r"(?i)example|sample|dummy|placeholder|xxxx|changeme|your[-_]",
            # Repeated groups are possessive: others are matched by recursion, as deep as the run is long.
            r"^[A-Za-z]++(?:[-_/=+][A-Za-z]++)*+([-_/=+]?[0-9]{1,4})?$",  # words, then a short number
            r"^(?:[A-Za-z]++[-_/])*+[0-9]{4}[-_/][0-9]{2}[-_/][0-9]{2}",  # dates in names and paths
        )
    )


# Running totals are made part by part; a part is copied as often as it has numbers.
_PART = 64


def _running(values: Column, take) -> Column:
    """What ``take`` makes of an array's values up to each place, from 0 on."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(
        values,
        F.struct(F.lit(0).cast("bigint").alias("last"), empty.alias("all")),
        lambda so_far, n: F.struct(
            take(so_far["last"], n).alias("last"),
            F.array_append(so_far["all"], take(so_far["last"], n)).alias("all"),
        ),
        lambda so_far: so_far["all"],
    )


def _once(value: Column, make) -> Column:
    """``make(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _running_long(values: Column, take) -> Column:
    """``_running`` of long arrays, in parts that start from what came before them."""

    def joined(parts: Column) -> Column:
        upto = _running(F.transform(parts, lambda p: F.element_at(p, -1)), take)
        before = F.concat(F.array(F.lit(0).cast("bigint")), upto)
        # there is one more total than there are parts
        zipped = F.zip_with(
            parts,
            F.slice(before, F.lit(1), F.size(parts)),
            lambda part, so_far: F.transform(part, lambda n: take(so_far, n)),
        )
        return F.flatten(zipped)

    def in_parts(v: Column) -> Column:
        count = F.ceil(F.size(v) / _PART).cast("int")
        parts = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: _running(F.slice(v, i * _PART + 1, F.lit(_PART)), take),
        )
        return F.when(F.size(v) <= _PART, _running(v, take)).otherwise(_once(parts, joined))

    return _once(values, in_parts)


def _ends(lengths: Column) -> Column:
    """Running totals of an array of lengths."""
    return _running_long(lengths, lambda total, n: total + n)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Start, end, whole match and one group's length for every match, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    spaced = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)),
        found,
        lambda gap, match: F.char_length(gap) + F.char_length(match).cast("bigint"),
    )
    return F.transform(
        F.arrays_zip(_ends(spaced).alias("end"), found.alias("match"), part.alias("part")),
        lambda m: F.struct(
            (m["end"] - F.char_length(m["match"])).alias("start"),
            m["end"].alias("end"),
            m["match"].alias("match"),
            F.char_length(m["part"]).alias("part_length"),
        ),
    )


def _none() -> Column:
    return F.array().cast(_SPAN)


def _span(start: Column, kind: str, end: Column) -> Column:
    return F.struct(
        start.cast("bigint").alias("start"),
        F.lit(_NAMES.index(kind)).alias("rank"),
        end.cast("bigint").alias("end"),
    )


def _base(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    kept = F.transform(
        F.filter(_matches(text, pattern, group), lambda m: m["part_length"] >= least),
        lambda m: _span(m["start"], kind, m["end"]),
    )
    return F.when(text.rlike(_MAY_HOLD[kind]), kept.cast(_SPAN)).otherwise(_none())


def _term(count: Column) -> Column:
    """What a character that occurs ``count`` times in the window adds to the sum."""
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def _high_part(run: Column, window: int, least_bits: Column) -> Column:
    """First start and last end of the windows of ``run`` that reach ``least_bits``; else nulls.

    The windows follow from a list of steps: a character leaves, another enters.
    The state holds the count of each character and the sum of their terms, from
    which the entropy is log2(window) - sum / window; a step changes one count.
    """

    def step(code: Column, change: int, at: Column) -> Column:
        return F.struct(code.alias("code"), F.lit(change).alias("change"), at.alias("at"))

    def all_steps(codes: Column) -> Column:
        return F.flatten(
            F.transform(
                codes,
                lambda code, i: F.when(i < window, F.array(step(code, 1, i))).otherwise(
                    F.array(step(F.get(codes, i - window), -1, i), step(code, 1, i))
                ),
            )
        )

    steps = _once(F.transform(F.split(run, ""), lambda c: F.ascii(c)), all_steps)

    def take(state: Column, one: Column) -> Column:
        count = F.get(state["counts"], one["code"])
        total = state["total"] + _term(count + one["change"]) - _term(count)
        bits = math.log2(window) - total / window
        high = (one["change"] == 1) & (one["at"] >= window - 1) & (bits >= least_bits)
        return F.struct(
            F.concat(
                F.slice(state["counts"], F.lit(1), one["code"]),
                F.array(count + one["change"]),
                F.slice(state["counts"], one["code"] + 2, F.lit(128)),
            ).alias("counts"),
            total.alias("total"),
            F.when(high & state["first"].isNull(), one["at"] - (window - 1))
            .otherwise(state["first"])
            .alias("first"),
            F.when(high, one["at"] + 1).otherwise(state["last"]).alias("last"),
        )

    nothing = F.lit(None).cast("int")
    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"),
        F.lit(0.0).alias("total"),
        nothing.alias("first"),
        nothing.alias("last"),
    )
    return F.aggregate(steps, start, take, lambda state: F.struct(state["first"], state["last"]))


def _least_bits(run: Column, rules: EntropyRules) -> Column:
    mixed = run.rlike("[a-z]") & run.rlike("[A-Z]")
    return (
        F.when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), rules.hex_bits)
        .when(mixed, rules.mixed_bits)
        .otherwise(rules.lower_bits)
    )


def _uncovered(text: Column, base: Column) -> Column:
    """The parts of the text that no span of ``base`` covers: start and text."""
    until = _running_long(base["end"], F.greatest)
    edges = F.arrays_zip(
        F.concat(F.array(F.lit(0).cast("bigint")), until).alias("from"),
        F.concat(base["start"], F.array(F.char_length(text).cast("bigint"))).alias("to"),
    )
    parts = F.transform(
        F.filter(edges, lambda e: e["from"] < e["to"]),
        lambda e: F.struct(
            e["from"].alias("start"),
            F.substring(text, (e["from"] + 1).cast("int"), (e["to"] - e["from"]).cast("int")).alias("text"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), text.alias("text")))
    return F.when(F.size(base) == 0, whole).otherwise(parts)


def _entropy(text: Column, base: Column, rules: EntropyRules) -> Column:
    """Spans of high entropy in what the spans of the patterns leave over."""
    long_run = f"{CANDIDATE}{{{rules.window},}}"

    def suspect(m: Column) -> Column:
        run = m["match"]
        held = run.rlike("[0-9]") & run.rlike("[A-Za-z]")
        for pattern in rules.allow:
            held = held & ~run.rlike(pattern)
        return held

    def high(m: Column, start: Column) -> Column:
        least = _least_bits(m["match"], rules)
        part = _once(least, lambda bits: _high_part(m["match"], rules.window, bits))
        return F.struct((start + m["start"]).alias("start"), part.alias("part"))

    runs = F.flatten(
        F.transform(
            _uncovered(text, base),
            lambda part: F.transform(
                F.filter(_matches(part["text"], long_run, 0), suspect), lambda m: high(m, part["start"])
            ),
        )
    )
    spans = F.transform(
        F.filter(runs, lambda m: m["part"]["first"].isNotNull()),
        lambda m: _span(
            m["start"] + m["part"]["first"], "entropy", m["start"] + m["part"]["last"]
        ),
    )
    # a run needs a digit, so that texts of long words alone are left early
    may_hold = text.rlike(f"{CANDIDATE}{{{rules.window}}}")
    return F.when(may_hold, spans.cast(_SPAN)).otherwise(_none())


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, _NAMES))
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.get(names, s["rank"]).alias("kind"),
        ),
    )


def scan(documents: DataFrame, text: str = "text", rules: EntropyRules | None = None) -> DataFrame:
    """``row`` (all columns given, as a struct), ``base`` and ``spans``.

    Both are arrays of (start, end, kind) in code points, end exclusive, by start
    and then kind: ``base`` holds what the patterns match, leftmost and without
    overlap within a kind; ``spans`` also what only the entropy test finds.

    Null and empty texts have empty arrays. Repeated rows are scanned each, other
    columns are only carried. Nothing is shuffled.
    """
    rules = rules or EntropyRules()
    rows = documents.select(F.struct("*").alias("row"), text_of(text).alias("text"))
    base = F.concat(*(_base(F.col("text"), *kind) for kind in KINDS))
    found = rows.withColumn("base", F.array_sort(base))
    both = F.array_sort(F.concat("base", _entropy(F.col("text"), F.col("base"), rules)))
    return found.withColumn("spans", both).select(
        "row", _named(F.col("base")).alias("base"), _named(F.col("spans")).alias("spans")
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans become one mask. Null stays null."""

    def replace(state: Column, span: Column) -> Column:
        gap = F.substring(
            text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int")
        )
        return F.struct(
            F.when(
                span["start"] >= state["at"], F.concat(state["made"], gap, F.lit(mask))
            )
            .otherwise(state["made"])
            .alias("made"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("made"), F.lit(0).cast("bigint").alias("at"))
    whole = F.aggregate(
        spans,
        start,
        replace,
        lambda s: F.concat(s["made"], F.substr(text, (s["at"] + 1).cast("int"))),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)
