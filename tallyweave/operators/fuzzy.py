"""Nearest title by edit distance, without comparing all pairs.

Cut a string into k + 1 segments: whoever is within k edits of it contains one
segment unchanged, shifted by at most k (Li, Deng, Wang, Feng: Pass-Join,
PVLDB 2011). Segments are hashed and the candidates come from an equi-join.

Up to there a title has keys for every length a grant within k edits may have, and
for every place of a segment. Long grants are therefore filed by class, lengths an
eighth of a power of two wide: their k + 1 segments have the length that the
class's shortest grant allows, from the start. One of them is unchanged with as many
edits before it as it has segments before it, so it has moved by no more than that,
and a long title has (k + 1) ** 2 keys in each of the one or two classes in its reach.

A key is weighed by the pairs it would list, its titles times its grants. Titles
that met a heavy key are matched at distance 1 first, then 2 and 3, so that a
dense cluster of near-copies is left at the nearest one. There a heavy key grows:
the rest of the string, left and right of the shared segment, must still be
within k edits, so it is cut into k + 1 segments in turn and the key takes in one
of those, ``GROWTHS`` times at most. What is heavy even then, and the titles
still open after the last distance, are compared in slices, of which only the
best grant per title leaves. There signatures are compared before the titles.
One half has a bit per bucket of letter pairs, set if an odd number of the title's
pairs falls into it; an edit changes four pairs at most. The other counts the
letters of each bucket in as many bits, up to eight; an edit changes two counts by
one at most. So titles within k edits differ in 4 k and 2 k bits at most, while
titles further apart mostly differ in more. Every step is exact; nothing is capped
or sampled.

Titles, grants and keys are joined by merging, as all of them grow with the input: what
Spark would take for small enough to broadcast is several times larger in memory.

Costs are bounded: a key lists ``HEAVY`` pairs at most; a grant has
(k + 1) keys at first, (d + 1) ** (GROWTHS + 1) at most at a nearer distance d;
a comparison in slices costs the titles concerned times their grants, a few
machine instructions for all pairs but those with near signatures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import usable
from tallyweave.runtime import cut

# Pairs a key may list, how often a heavy key grows, and the distances tried first.
HEAVY, GROWTHS, NEAREST = 1_000_000, 2, 3

# Grants that are compared with a title at a time.
SLICE = 256

# Grants are filed by class from this many times the reach of lengths on.
LONG = 16

# Words of 64 bits in each half of a signature, and how many of its bits one edit flips at most.
SIGNATURE_WORDS, PAIRS_FLIPPED, LETTERS_FLIPPED = 4, 4, 2


def best_edit_matches(
    titles: DataFrame, grants: DataFrame, max_distance: int = 5, heavy: int = HEAVY
) -> DataFrame:
    """``title``, ``grant_id``, ``grant_title``, ``distance`` of every title's best grant.

    ``titles`` has ``title``; ``grants`` has ``title`` and ``grant_id``; both
    titles are normalised. The best grant has the smallest distance, then the
    smallest id. Titles without a grant within ``max_distance`` are left out, and
    NULL or blank titles never match. Runs jobs: the distinct titles and the keys
    that titles and grants share are written to the shared folder.
    """
    wanted = cut(
        titles.where(usable(F.col("title")))
        .groupBy(F.unhex(F.md5("title")).alias("tid"))
        .agg(F.first("title").alias("title")),
        "titles",
    )
    known = cut(grants_in_reach(grants, wanted, max_distance), "grants")
    best = nearest_grants(wanted, known, max_distance, heavy)
    return (
        best.join(wanted.hint("merge"), "tid")
        .join(known.select("gid", F.col("title").alias("grant_title")).hint("merge"), "gid")
        .select("title", "grant_id", "grant_title", "distance")
    )


def grants_in_reach(grants: DataFrame, wanted: DataFrame, max_distance: int) -> DataFrame:
    """One grant per title, by a digest ``gid``, of those that are neither too short nor too long.

    The smallest id stands for its title. Runs a job for the lengths of ``wanted``.
    """
    shortest, longest = wanted.agg(F.min(F.length("title")), F.max(F.length("title"))).first()
    if shortest is None:
        shortest = longest = 0
    in_reach = F.length("title").between(shortest - max_distance, longest + max_distance)
    return (
        grants.where(usable(F.col("title")) & in_reach)
        .groupBy(F.unhex(F.md5("title")).alias("gid"))
        .agg(F.min("grant_id").alias("grant_id"), F.first("title").alias("title"))
    )


def nearest_grants(
    wanted: DataFrame, known: DataFrame, max_distance: int = 5, heavy: int = HEAVY
) -> DataFrame:
    """``tid``, ``distance``, ``grant_id``, ``gid`` of every title's best grant.

    ``wanted`` has ``tid`` and ``title``, ``known`` has ``gid``, ``grant_id`` and
    ``title``: written tables, each title once and neither NULL nor blank.
    """
    title_keys = _whole_titles(wanted, max_distance)
    shared = _shared_keys(title_keys, _whole_grants(known, max_distance))
    dense = cut(
        title_keys.join(_heavy_keys(shared, heavy), "key", "left_semi").select("tid").distinct(),
        "dense",
    )
    light_keys = title_keys.join(dense, "tid", "left_anti")
    # a class holds grants of lengths that a title cannot reach
    apart = F.abs(F.col("title_size") - F.col("grant_size"))
    light = _joined(light_keys, shared).where(apart.isNull() | (apart <= max_distance))
    results = [_verified(light.select("tid", "gid"), wanted, known, max_distance)]
    if dense.take(1):
        open_titles = cut(wanted.join(dense, "tid", "left_semi"), "open")
        asked = title_keys.join(dense, "tid", "left_semi").select("key").distinct()
        around = shared.join(asked.hint("merge"), "key", "left_semi").select("gid").distinct()
        near = cut(known.join(around.hint("merge"), "gid", "left_semi"), "near-grants")
        for distance in range(1, min(NEAREST, max_distance) + 1):
            nearest = cut(_refined(open_titles, near, distance, heavy), f"within-{distance}")
            results.append(nearest)
            open_titles = cut(open_titles.join(nearest, "tid", "left_anti"), "open")
        if max_distance > NEAREST:
            results.append(_compared(open_titles, near, max_distance))
    return reduce(DataFrame.unionByName, results)


def _shared_keys(title_keys: DataFrame, grant_keys: DataFrame) -> DataFrame:
    """The grants' keys that some title asks for, written once, with the number of its titles."""
    asked = cut(title_keys.groupBy("key").agg(F.count(F.lit(1)).alias("asked")), "asked-keys")
    return cut(grant_keys.join(asked.hint("merge"), "key"), "grant-keys")


def _heavy_keys(shared: DataFrame, heavy: int) -> DataFrame:
    """Keys that would list more than ``heavy`` pairs."""
    weighed = shared.groupBy("key").agg(F.sum("asked").alias("pairs"))
    return cut(weighed.where(F.col("pairs") > heavy).select("key"), "heavy-keys")


def _refined(titles: DataFrame, grants: DataFrame, k: int, heavy: int) -> DataFrame:
    """The best grant at distance ``k`` at most, heavy keys grown and then compared in slices."""
    title_parts, grant_parts = _seed_titles(titles, k), _seed_grants(grants)
    found = []
    for growth in range(GROWTHS + 1):
        title_keys = cut(_split_titles(title_parts, k), "title-keys")
        shared = _shared_keys(title_keys, _split_grants(grant_parts, k))
        hot = _heavy_keys(shared, heavy)
        listed = _pairs(
            title_keys.join(hot, "key", "left_anti"), shared.join(hot, "key", "left_anti")
        )
        found.append(_verified(listed, titles, grants, k))
        if not hot.take(1):
            break
        # a key that has used up the string cannot grow
        may_grow = (F.col("rest") > k) if growth < GROWTHS else F.lit(False)
        title_hot = title_keys.join(hot, "key", "left_semi")
        grant_hot = shared.join(hot, "key", "left_semi")
        found.append(
            _compared(
                title_hot.where(~may_grow).select("key", "tid").distinct().join(titles, "tid"),
                grant_hot.where(~may_grow).select("key", "gid").distinct().join(grants, "gid"),
                k,
                by="key",
            )
        )
        if growth == GROWTHS:
            break
        title_parts = title_hot.where(may_grow).select("tid", "key", "gaps").join(
            titles.select("tid", "title"), "tid"
        )
        grant_parts = grant_hot.where(may_grow).select("gid", "key", "gaps").join(
            grants.select("gid", "title"), "gid"
        )
    return _best(reduce(DataFrame.unionByName, found))


def _joined(title_keys: DataFrame, grant_keys: DataFrame) -> DataFrame:
    return title_keys.join(grant_keys.hint("merge"), "key")


def _pairs(title_keys: DataFrame, grant_keys: DataFrame) -> DataFrame:
    return _joined(title_keys.select("key", "tid"), grant_keys.select("key", "gid")).select(
        "tid", "gid"
    )


def _best(found: DataFrame) -> DataFrame:
    """One row per title: the smallest distance, then the smallest grant id."""
    best = F.min(F.struct("distance", "grant_id", "gid")).alias("best")
    return found.groupBy("tid").agg(best).select("tid", "best.*")


def _verified(pairs: DataFrame, titles: DataFrame, grants: DataFrame, k: int) -> DataFrame:
    """The best grant per title among candidate pairs, at most ``k`` edits away."""
    right = grants.select("gid", "grant_id", F.col("title").alias("grant_title"))
    return _best(
        pairs.distinct()
        .join(titles.select("tid", "title").hint("merge"), "tid")
        .join(right.hint("merge"), "gid")
        .withColumn("distance", F.levenshtein(F.col("title"), F.col("grant_title"), k))
        .where(F.col("distance") >= 0)
        .select("tid", "distance", "grant_id", "gid")
    )


def _compared(titles: DataFrame, grants: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """The best grant per title among all of the same ``by``, or of fitting length.

    Grants are gathered into slices of about ``SLICE``; a title meets a slice in
    one row, which leaves with the best of the slice. Only grants whose signature
    is near are compared by their letters.
    """
    slices = F.ceil(F.lit(grants.count()) / SLICE)
    own = F.col(by) if by else F.length("title")
    sliced = (
        grants.select(
            own.alias("of"),
            F.pmod(F.xxhash64("gid"), F.greatest(slices, F.lit(1))).alias("slice"),
            F.struct("title", "grant_id", "gid", signature(F.col("title")).alias("signature")).alias("grant"),
        )
        .groupBy("of", "slice")
        .agg(F.collect_list("grant").alias("slice_of"))
    )
    lengths = F.explode(F.sequence(F.length("title") - k, F.length("title") + k))
    asked = titles.withColumn("signature", signature(F.col("title"))).select(
        "tid", "title", "signature", (F.col(by) if by else lengths).alias("of")
    )
    title = F.col("title")
    near = F.transform(
        F.filter("slice_of", lambda g: may_be_near(F.col("signature"), g["signature"], k)),
        lambda g: F.struct(
            F.levenshtein(title, g["title"], k).alias("distance"),
            g["grant_id"].alias("grant_id"),
            g["gid"].alias("gid"),
        ),
    )
    best = F.array_min(F.filter(near, lambda n: n["distance"] >= 0))
    return _best(
        asked.join(cut(sliced, "slices"), "of")
        .select("tid", best.alias("best"))
        .where(F.col("best").isNotNull())
        .select("tid", "best.*")
    )


def _put(words: list[Column], word: Column, change) -> list[Column]:
    """The words of a half, with ``change`` made to the one numbered ``word``."""
    return [F.when(word == i, change(w)).otherwise(w) for i, w in enumerate(words)]


def signature(title: Column) -> Column:
    """The letter pairs and the letters of a title in bits; an array of words."""
    n = SIGNATURE_WORDS
    shift = lambda x, by: F.call_function("shiftleft", x, by.cast("int"))
    one = F.lit(1).cast("bigint")

    def take(state: Column, at: Column) -> Column:
        words = [state[f"w{i}"] for i in range(2 * n)]
        pair = F.pmod(F.xxhash64(F.substring(title, at, F.lit(2))), F.lit(64 * n))
        pairs = _put(words[:n], F.floor(pair / 64), lambda w: w.bitwiseXOR(shift(one, pair % 64)))
        # the last place has a letter, but no pair
        pairs = [F.when(at < F.length(title), new).otherwise(old) for new, old in zip(pairs, words)]
        letter = F.pmod(F.xxhash64(F.substring(title, at, F.lit(1))), F.lit(8 * n))
        lane = (letter % 8) * 8

        def count(w: Column) -> Column:
            held = F.call_function("shiftrightunsigned", w, lane.cast("int")).bitwiseAND(F.lit(255))
            return w.bitwiseOR(shift((held * 2 + 1).bitwiseAND(F.lit(255)).cast("bigint"), lane))

        letters = _put(words[n:], F.floor(letter / 8), count)
        return F.struct(*[w.alias(f"w{i}") for i, w in enumerate(pairs + letters)])

    places = F.when(title != "", F.sequence(F.lit(1), F.length(title)))
    none = F.struct(*[F.lit(0).cast("bigint").alias(f"w{i}") for i in range(2 * n)])
    return F.aggregate(
        F.coalesce(places, F.array().cast("array<int>")),
        none,
        take,
        lambda state: F.array(*[state[f"w{i}"] for i in range(2 * n)]),
    )


def may_be_near(left: Column, right: Column, k: int) -> Column:
    """Whether titles with these signatures can be within ``k`` edits."""
    differ = [
        F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i))))
        for i in range(2 * SIGNATURE_WORDS)
    ]
    pairs, letters = differ[:SIGNATURE_WORDS], differ[SIGNATURE_WORDS:]
    return (reduce(Column.__add__, letters) <= LETTERS_FLIPPED * k) & (
        reduce(Column.__add__, pairs) <= PAIRS_FLIPPED * k
    )


def _long_from(k: int) -> int:
    return LONG * (2 * k + 1)


def _class_of(size: Column) -> Column:
    """The shortest length in a length's class; powers of two are cut into eight classes each."""
    return size - size % F.call_function("shiftleft", F.lit(1), F.length(F.bin(size)) - 4)


def _segment_keys(start: Column, k: int, moved: bool) -> Column:
    """The key of each of the first ``k + 1`` segments of class ``start``, at all its places if ``moved``."""
    width = F.floor(start / (k + 1)).cast("int")

    def at(s: Column, place: Column) -> Column:
        # four bytes a character, so that a segment is found without counting through
        piece = F.substring(F.col("units"), place * 4 + 1, width * 4)
        whole = (place >= 0) & (place + width <= F.col("size"))
        return F.when(whole, F.xxhash64(F.lit("class"), start, s, piece))

    def of_segment(s: Column) -> Column:
        if not moved:
            return F.array(at(s, s * width))
        return F.transform(F.sequence(-s, s), lambda shift: at(s, s * width + shift))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k)), of_segment))


def _whole_grants(grants: DataFrame, k: int) -> DataFrame:
    """``gid``, ``grant_size`` and ``key``: short grants by their exact length, long ones by class."""
    size = F.length("title")
    short = _split_grants(_seed_grants(grants.where(size < _long_from(k))), k)
    long = (
        grants.where(size >= _long_from(k))
        .select("gid", size.alias("size"), F.encode("title", "utf-32").alias("units"))
        .select(
            "gid",
            F.col("size").alias("grant_size"),
            F.explode(_segment_keys(_class_of(F.col("size")), k, moved=False)).alias("key"),
        )
    )
    # the key of a short one holds its length
    return short.select("gid", F.lit(None).cast("int").alias("grant_size"), "key").unionByName(long)


def _whole_titles(titles: DataFrame, k: int) -> DataFrame:
    """``tid``, ``title_size`` and ``key`` for every grant length within ``k`` of a title's own."""
    size, long = F.length("title"), F.lit(_long_from(k))
    short = _split_titles(_seed_titles(titles, k, _long_from(k) - 1), k)
    reached = F.sequence(F.greatest(long, F.col("size") - k), F.col("size") + k)
    classes = F.array_distinct(F.transform(reached, _class_of))
    by_class = F.transform(classes, lambda start: _segment_keys(start, k, moved=True))
    by_class = (
        titles.where(size + k >= long)
        .select("tid", size.alias("size"), F.encode("title", "utf-32").alias("units"))
        .select(
            "tid",
            F.col("size").alias("title_size"),
            F.explode(F.array_distinct(F.flatten(by_class))).alias("key"),
        )
        .where(F.col("key").isNotNull())
    )
    return short.select("tid", F.lit(None).cast("int").alias("title_size"), "key").unionByName(by_class)


# ``gaps`` are the stretches of a grant title no key segment covers yet, each with
# its start ``gs`` and length ``gl`` in the grant, the open length ``gp`` before
# it, and the stretch ``ts``, ``tl`` of the title it has to be aligned with.


def _gap(gs, gl, gp, ts, tl) -> Column:
    fields = {"gs": gs, "gl": gl, "gp": gp, "ts": ts, "tl": tl}
    return F.struct(*[c.cast("int").alias(name) for name, c in fields.items()])


def _seed_grants(grants: DataFrame) -> DataFrame:
    """Every grant keyed by its length, all of it still open."""
    size, zero = F.length("title"), F.lit(0)
    return grants.select(
        "gid",
        "title",
        F.xxhash64(size).alias("key"),
        F.array(_gap(zero, size, zero, zero, zero)).alias("gaps"),
    )


def _seed_titles(titles: DataFrame, k: int, longest: int | None = None) -> DataFrame:
    """Every title once per grant length within ``k`` of its own, up to ``longest``."""
    size, zero = F.length("title"), F.lit(0)
    last = size + k
    if longest is not None:
        titles, last = titles.where(size - k <= longest), F.least(last, F.lit(longest))
    lengths = F.sequence(F.greatest(F.lit(1), size - k), last)
    return titles.select("tid", "title", F.explode(lengths).alias("_l")).select(
        "tid",
        "title",
        F.xxhash64(F.col("_l")).alias("key"),
        F.array(_gap(zero, F.col("_l"), zero, zero, size)).alias("gaps"),
    )


def _segments(parts: DataFrame, k: int) -> DataFrame:
    """Cut what is open into ``k + 1`` segments, shared out to the gaps by length.

    One row per segment: gap number ``j``, segment ``s`` of the gap's ``n``, its
    start ``a`` and end ``b`` in the grant. ``rest`` is the open length left after it.
    """
    last = F.element_at("gaps", -1)
    total = last["gp"] + last["gl"]
    share = lambda upto: F.floor((k + 1) * upto / F.col("_open")).cast("int")
    g = F.col("g")
    return (
        parts.withColumn("_open", total)
        .where(F.col("_open") > k)
        # Four bytes a character, so that a segment is found without counting through.
        .withColumn("units", F.encode("title", "utf-32"))
        .drop("title")
        .select("*", F.posexplode("gaps").alias("j", "g"))
        .withColumn("n", share(g["gp"] + g["gl"]) - share(g["gp"]))
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(k))))
        .where(F.col("s") < F.col("n"))
        .withColumn("a", (g["gs"] + F.floor(F.col("s") * g["gl"] / F.col("n"))).cast("int"))
        .withColumn("b", (g["gs"] + F.floor((F.col("s") + 1) * g["gl"] / F.col("n"))).cast("int"))
        .withColumn("rest", F.col("_open") - F.col("b") + F.col("a"))
    )


def _key(start: Column) -> Column:
    """The key so far, lengthened by a segment of the text at ``start``."""
    piece = F.substring(F.col("units"), start * 4 + 1, (F.col("b") - F.col("a")) * 4)
    return F.xxhash64("key", "j", "s", piece)


def _next_gaps(title_start: Column) -> Column:
    """The gaps after one of them has been split around the chosen segment."""
    g, a, b, j = F.col("g"), F.col("a"), F.col("b"), F.col("j")
    left = _gap(g["gs"], a - g["gs"], g["gp"], g["ts"], title_start - g["ts"])
    title_end = title_start + b - a
    right = _gap(
        b,
        g["gs"] + g["gl"] - b,
        g["gp"] + a - g["gs"],
        title_end,
        g["ts"] + g["tl"] - title_end,
    )
    moved = lambda h: _gap(h["gs"], h["gl"], h["gp"] - b + a, h["ts"], h["tl"])
    return F.concat(
        F.slice("gaps", F.lit(1), j),
        F.filter(F.array(left, right), lambda h: h["gl"] > 0),
        F.transform(F.slice("gaps", j + 2, F.size("gaps") - j - 1), moved),
    )


def _used_up(parts: DataFrame, k: int, row_id: str) -> DataFrame:
    """Rows with too little open text for ``k + 1`` segments keep the key they have."""
    last = F.element_at("gaps", -1)
    total = F.coalesce(last["gp"] + last["gl"], F.lit(0))
    return parts.where(total <= k).select(
        row_id, F.xxhash64("key", F.lit("end")).alias("key"), "gaps", F.lit(0).alias("rest")
    )


def _split_grants(parts: DataFrame, k: int) -> DataFrame:
    """One row per grant and segment, keyed by the segment."""
    split = _segments(parts, k)
    rows = split.select(
        "gid",
        _key(F.col("a")).alias("key"),
        _next_gaps(F.lit(0)).alias("gaps"),
        F.col("rest").cast("int").alias("rest"),
    )
    return rows.unionByName(_used_up(parts, k, "gid"))


def _split_titles(parts: DataFrame, k: int) -> DataFrame:
    """One row per title and place where a grant's segment may stand in it.

    With i segments of the gap to its left and n - 1 - i to its right, a segment
    is found with at most i edits before it and at most n - 1 - i after it, which
    bounds how far it can have moved.
    """
    g, n, s = F.col("g"), F.col("n"), F.col("s")
    drift = g["tl"] - g["gl"]
    lowest = F.greatest(-s, drift - (n - 1 - s))
    highest = F.least(s, drift + (n - 1 - s))
    start = F.col("a") - g["gs"] + g["ts"] + F.col("shift")
    split = (
        _segments(parts, k)
        .withColumn("_lowest", lowest)
        .withColumn("_highest", highest)
        .where(F.col("_lowest") <= F.col("_highest"))
        .withColumn("shift", F.explode(F.sequence("_lowest", "_highest")))
        .withColumn("_start", start.cast("int"))
        .where(
            (F.col("_start") >= g["ts"])
            & (F.col("_start") + F.col("b") - F.col("a") <= g["ts"] + g["tl"])
        )
    )
    rows = split.select(
        "tid",
        _key(F.col("_start")).alias("key"),
        _next_gaps(F.col("_start")).alias("gaps"),
        F.col("rest").cast("int").alias("rest"),
    )
    return rows.unionByName(_used_up(parts, k, "tid"))
