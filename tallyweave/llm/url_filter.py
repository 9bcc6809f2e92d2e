"""URL filters: stated host and path rules, and association rules mined from labels.

The tokens of a labelled page's URL and its label make a transaction. FP-growth
finds the token combinations that go with a "block" label; those of enough
support and confidence become rules. A rule is filed under its rarest token, so a
URL looks up its own tokens and tests only the rules filed there.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from zlib import crc32

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import small
from tallyweave.runtime import cut

# Labelled pages that rules are mined from at most.
MOST_PAGES = 200_000
_BLOCK = "label:block"


@dataclass(frozen=True)
class StatedRule:
    """``verdict`` for a host, all its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules that are given.
STATED = (
    StatedRule("block", "net", "/"),
    StatedRule("allow", "example.net", "/en/"),
    StatedRule("block", "example.com", "/de/"),
    StatedRule("allow", "org", "/fr/"),
)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    lower = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(
        F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit("")
    )


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels, path segments, query parts and fragment; numbers as ``#``."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(rest, "^[^#]*#(.*)$", 1)
    parts = (
        ("host:", F.split(host_of(url), r"\.")),
        ("path:", F.split(F.lower(path_of(url)), r"[/.]")),
        ("query:", F.split(F.lower(query), "[&;]")),
        ("fragment:", F.array(F.lower(fragment))),
    )

    def marked(kind: str, values: Column) -> Column:
        plain = F.transform(values, lambda v: F.regexp_replace(v, "[0-9]+", "#"))
        kept = F.filter(plain, lambda v: v != "")
        return F.transform(kept, lambda v: F.concat(F.lit(kind), v))

    return F.array_distinct(F.concat(*(marked(*part) for part in parts)))


@dataclass(frozen=True)
class MinedRules:
    """Token sets that block a URL, filed under their rarest token."""

    index: dict[str, tuple[frozenset[str], ...]]

    def blocks(self, tokens: Column) -> Column:
        """Whether some rule's tokens are all among ``tokens``."""
        if not self.index:
            return F.lit(False)
        # a token finds its rules by its place in a list, however many rules there are
        places = defaultdict(list)
        for token, rules in sorted(self.index.items()):
            places[crc32(token.encode()) % len(self.index)].extend(rules)
        none = F.array().cast("array<array<string>>")
        filed = F.array(
            *(
                F.array(*(F.array(*map(F.lit, sorted(rule))) for rule in places[place]))
                if place in places
                else none
                for place in range(len(self.index))
            )
        )

        def fits(rule: Column) -> Column:
            return F.size(F.array_except(rule, tokens)) == 0

        def place(token: Column) -> Column:
            return F.pmod(F.crc32(token), F.lit(len(self.index))).cast("int")

        return F.exists(tokens, lambda token: F.exists(F.get(filed, place(token)), fits))


def file_rules(
    rules: Sequence[tuple[frozenset[str], float]], most: int | None = None
) -> MinedRules:
    """The index of the rules that say more than the shorter ones.

    A rule is left out if a subset of its tokens is a rule of at least its
    confidence. Of more than ``most``, if given, the surest stay.
    """
    kept: list[tuple[frozenset[str], float]] = []
    by_least = defaultdict(list)
    for tokens, sure in sorted(rules, key=lambda r: (len(r[0]), -r[1], sorted(r[0]))):
        if not any(
            short <= tokens and sure <= as_sure
            for token in tokens
            for short, as_sure in by_least[token]
        ):
            kept.append((tokens, sure))
            by_least[min(tokens)].append((tokens, sure))
    kept = sorted(kept, key=lambda r: (-r[1], len(r[0]), sorted(r[0])))[:most]
    uses = Counter(token for tokens, _ in kept for token in tokens)
    index = defaultdict(list)
    for tokens, _ in kept:
        index[min(tokens, key=lambda t: (uses[t], t))].append(tokens)
    return MinedRules({token: tuple(filed) for token, filed in index.items()})


def mine(
    pages: DataFrame,
    labels: DataFrame,
    least_support: float = 0.002,
    least_confidence: float = 0.6,
    most_pages: int = MOST_PAGES,
) -> MinedRules:
    """All rules of enough support and confidence, from about ``most_pages`` labelled pages at most.

    A rule that holds all tokens of a shorter one is left out, however sure: it
    blocks no page that the shorter does not.

    A page's label is that of the document whose id is the first number of its
    path: "block" for low quality (0) or toxic (1). Pages without such a
    document, without a URL or with both labels null are left out; without any
    there are no rules. ``least_support`` is the share of labelled pages that
    hold the tokens and are to be blocked.
    """
    number = F.regexp_extract(path_of(F.col("url")), "([0-9]{1,18})", 1)
    urls = pages.select(
        F.nullif(number, F.lit("")).cast("bigint").alias("id"),
        tokens_of(F.col("url")).alias("tokens"),
    ).where(F.col("id").isNotNull())
    known = labels.select(
        F.col("doc_id").alias("id"),
        ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"),
    ).where(F.col("block").isNotNull() & F.col("id").isNotNull())
    share = most_pages / max(known.count(), 1)
    place = F.pmod(F.xxhash64("id", F.lit("pages")), F.lit(1 << 30)) / (1 << 30)
    label = F.when(F.col("block"), F.array(F.lit(_BLOCK))).otherwise(
        F.array().cast("array<string>")
    )
    baskets = cut(
        urls.join(small(known.where(place < share), 24), "id")
        .select(F.concat("tokens", label).alias("items"))
        .where(F.size("items") > 0),
        "url-baskets",
    )
    if not baskets.where(F.array_contains("items", _BLOCK)).take(1):
        return MinedRules({})
    model = FPGrowth(
        itemsCol="items", minSupport=least_support, minConfidence=least_confidence
    ).fit(baskets)
    found = model.associationRules.where(F.get("consequent", 0) == _BLOCK).select("antecedent")
    return file_rules([(frozenset(r[0]), 1.0) for r in found.toLocalIterator()])


def judge(
    pages: DataFrame,
    mined: MinedRules,
    stated: Sequence[StatedRule] = STATED,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    The longest stated rule that fits decides, ties by name; else the mined
    rules; else the verdict is ``allow``. A null URL or one without ``://`` has an
    empty host and path, which no rule fits. Null and repeated ids are kept, other
    columns ignored. Nothing is shuffled.
    """
    given = F.col(f"`{url}`").cast("string")
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        host_of(given).alias("host"),
        path_of(given).alias("path"),
        tokens_of(given).alias("tokens"),
    )
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for one in sorted(stated, key=lambda r: (len(r.name), r.name)):
        own = (F.col("host") == one.host) | F.col("host").endswith("." + one.host)
        fits = own & F.col("path").startswith(one.path)
        rule = F.when(fits, one.name).otherwise(rule)
        verdict = F.when(fits, one.verdict).otherwise(verdict)
    by_method = F.when(mined.blocks(F.col("tokens")), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, by_method).alias("verdict"),
    )
