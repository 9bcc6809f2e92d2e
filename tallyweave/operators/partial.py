"""Partial matches: titles that share a long word, or part of one.

A word of one title lies inside another normalised title exactly when it lies
inside one of that title's words, since words hold no blanks. So the containment
is settled between the two vocabularies, and only the first few grants of every
word travel on. No pair of titles is formed.

A word lies inside another exactly if it begins one of its suffixes. In the
sorted list of all words and all suffixes, the suffixes that a word begins follow
it in one run, and the words that begin a suffix are nested. One pass over the
list, with the words of the current nest on a stack, answers both directions.
The list is dealt out by its first characters, as many as the shortest word has,
so that no run is parted. It has a row per character of the vocabulary: of each
suffix only its first ``HEAD`` characters, which settle all but the longest words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import words
from tallyweave.operators.dedupe import top_per_key
from tallyweave.runtime import cut

# Characters that are kept of a suffix. Longer words are known by a digest.
HEAD = 64

# The two kinds of a match, in the order in which one grant gives them.
IN_GRANT, IN_TITLE = 1, 2
_PAIRS = pa.schema([("asked", pa.string()), ("word", pa.string()), ("kind", pa.int32())])


def _title_words(df: DataFrame, key: str, min_length: int) -> DataFrame:
    """The long words of each title: ``word`` names them, ``long`` is the text where that differs."""
    found = F.array_distinct(words(F.col("title"), min_length - 1))
    text, long = F.col("text"), F.length("text") > HEAD
    # words hold no blank, so the name of a long one is no other word
    return df.select(key, F.explode(found).alias("text")).select(
        key,
        F.when(long, F.concat(F.lit(" "), F.md5("text"))).otherwise(text).alias("word"),
        F.when(long, text).alias("long"),
    )


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of words of which one begins a suffix of the other, from a sorted list.

    A pair that comes twice in a row, as in a word that repeats itself, is given once.
    """
    nest: list[list] = []  # head, word, asked, known, last partner
    for batch in batches:
        made = []
        columns = ("head", "whole", "word", "asked", "known")
        for head, whole, word, asked, known in zip(*(batch.column(c).to_pylist() for c in columns)):
            while nest and not head.startswith(nest[-1][0]):
                nest.pop()
            if whole:
                nest.append([head, word, asked, known, None])
                continue
            for inner in nest:
                if inner[4] == word:
                    continue
                inner[4] = word
                if inner[2] and known:
                    made.append((inner[1], word, IN_GRANT))
                if inner[3] and asked:
                    made.append((word, inner[1], IN_TITLE))
        columns = zip(*made) if made else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _PAIRS)], schema=_PAIRS
        )


def _contained(asked: DataFrame, known: DataFrame, min_length: int) -> DataFrame:
    """``asked``, ``word``, ``kind`` of all pairs of an asked and a known word, one in the other."""
    sides = [
        side.select("word", "long", F.lit(i == 0).alias("asked"), F.lit(i == 1).alias("known"))
        for i, side in enumerate((asked, known))
    ]
    both = cut(
        sides[0].unionByName(sides[1]).groupBy("word").agg(
            F.max("long").alias("long"), F.max("asked").alias("asked"), F.max("known").alias("known")
        ),
        "vocabulary",
    )
    text = F.coalesce("long", "word")
    begin = F.substring("head", 1, min_length).alias("begin")
    whole = both.withColumns({"head": F.substring(text, 1, HEAD), "whole": F.lit(True)})
    places = F.sequence(F.lit(1), F.length(text) - min_length + 1)
    suffixes = both.withColumn("at", F.explode(places)).withColumns(
        {"head": F.substring(text, F.col("at"), F.lit(HEAD)), "whole": F.lit(False)}
    )
    # words that are only known matter where an asked word may begin in them
    beginnings = whole.where("asked").select(begin).distinct()
    reached = suffixes.where("NOT asked").withColumn("begin", begin)
    reached = reached.join(beginnings, "begin", "left_semi")
    columns = ["head", "whole", "word", "asked", "known"]
    rows = reduce(
        DataFrame.unionByName,
        [part.select(*columns) for part in (whole, suffixes.where("asked"), reached)],
    )
    partitions = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = (
        rows.repartition(partitions, begin)
        .sortWithinPartitions("head", F.col("whole").desc(), "word")
        .mapInArrow(_nested, "asked string, word string, kind int")
    )
    # of a word longer than a head only the beginning has been compared
    pairs = cut(pairs.distinct(), "contained")
    inner = F.when(F.col("kind") == IN_GRANT, F.col("asked")).otherwise(F.col("word"))
    is_long = F.startswith(inner, F.lit(" "))
    texts = both.where(F.col("long").isNotNull()).select(F.col("word").alias("name"), "long")

    def with_text(df: DataFrame, name: str) -> DataFrame:
        other = texts.withColumnsRenamed({"name": name, "long": f"{name}_text"})
        return df.join(other, name)

    # what holds a long word is long itself
    held = F.when(F.col("kind") == IN_GRANT, F.col("word_text")).otherwise(F.col("asked_text"))
    holds = F.when(F.col("kind") == IN_GRANT, F.col("asked_text")).otherwise(F.col("word_text"))
    verified = with_text(with_text(pairs.where(is_long), "asked"), "word").where(
        F.contains(held, holds)
    )
    return pairs.where(~is_long).unionByName(verified.select("asked", "word", "kind"))


def partial_matches(
    titles: DataFrame,
    grants: DataFrame,
    min_length: int = 5,
    keep: int = 5,
) -> DataFrame:
    """The first ``keep`` partial matches of every title, in grant order.

    ``titles`` has ``title_id`` and ``title``; ``grants`` has ``grant_id`` and
    ``title``; both titles are normalised. A grant gives ``word_in_grant`` when
    it contains a long word of the title, then ``word_in_unmatched`` when the
    title contains a long word of the grant. A list cut to its first ``keep``
    entries at every step holds the first ``keep`` of the whole. Writes the words
    of both sides to the shared folder; ``grants`` is read twice, for its words
    and for the titles of what was found.
    """
    title_words = cut(_title_words(titles, "title_id", min_length), "title-words")
    grant_words = _title_words(grants, "grant_id", min_length)
    first_grants = cut(
        top_per_key(grant_words, ["word"], [F.col("grant_id")], keep), "first-grants"
    )
    reached = _contained(title_words, first_grants, min_length)
    per_word = top_per_key(
        reached.join(first_grants.select("word", "grant_id"), "word")
        .select("asked", "kind", "grant_id")
        .distinct(),
        ["asked", "kind"],
        [F.col("grant_id")],
        keep,
    )
    per_title = top_per_key(
        title_words.select("title_id", F.col("word").alias("asked"))
        .join(per_word, "asked")
        .select("title_id", "kind", "grant_id")
        .distinct(),
        ["title_id"],
        [F.col("grant_id"), F.col("kind")],
        keep,
    )
    return per_title.join(
        grants.select("grant_id", F.col("title").alias("grant_title")), "grant_id"
    ).select(
        "title_id",
        "grant_id",
        "grant_title",
        F.when(F.col("kind") == IN_GRANT, "word_in_grant").otherwise("word_in_unmatched").alias("match_type"),
    )
