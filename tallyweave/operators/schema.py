"""Find columns whose names drift, and bring tables to one shape.

Only column names are looked at, so nothing here starts a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import columns as C
from tallyweave.functions.text import clean_name


def ref(name: str) -> Column:
    """Column of that exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick_column(
    available: Sequence[str], candidates: Iterable[str], fragments: Iterable[str]
) -> str | None:
    """First candidate present, else the first column containing a fragment."""
    for name in candidates:
        if name in available:
            return name
    parts = tuple(fragments)
    return next((c for c in available if any(p in c.lower() for p in parts)), None)


def name_column(df: DataFrame) -> str | None:
    return pick_column(df.columns, C.NAME_CANDIDATES, C.NAME_FRAGMENTS)


def title_column(df: DataFrame) -> str | None:
    return pick_column(df.columns, (C.TITLE_COLUMN,), C.TITLE_FRAGMENTS)


def select_targets(df: DataFrame, targets: Iterable[str]) -> list[Column]:
    """The targets the table has in any letter case, under their usual spelling.

    They are read as text, so that years which store numbers can be stacked on
    years which store words.
    """
    by_lower: dict[str, str] = {}
    for name in df.columns:
        by_lower.setdefault(name.lower(), name)
    return [
        ref(by_lower[t.lower()]).cast("string").alias(t) for t in targets if t.lower() in by_lower
    ]


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [name for name in required if name not in df.columns]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """The same table, or an error that names what it lacks."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing {missing}; the table has {df.columns}")
    return df


def available_enrichment(df: DataFrame, mapping: dict[str, str]) -> dict[str, str]:
    """The part of an enrichment mapping the table can serve; an error if none."""
    served = {source: target for source, target in mapping.items() if source in df.columns}
    if not served:
        raise ValueError(f"none of {list(mapping)} found; the table has {df.columns}")
    return served


def align_by_name(
    df: DataFrame,
    fiscal_year: Column,
    targets: Iterable[str] = C.NAME_ENRICHMENT,
    keep: Iterable[str] = (),
) -> DataFrame | None:
    """``clean_name``, ``fiscal_year`` and the targets present; None without a name column."""
    name = name_column(df)
    if name is None:
        return None
    return df.select(
        clean_name(ref(name).cast("string")).alias("clean_name"),
        fiscal_year.alias("fiscal_year"),
        *select_targets(df, targets),
        *[ref(c) for c in keep],
    )


def stack(frames: Sequence[DataFrame]) -> DataFrame | None:
    """Union by column name, absent columns NULL. None for no frames.

    Names that differ in letter case only are one column, under the spelling met
    first. A column whose type differs between frames becomes text in all of
    them. Frames are joined pairwise in rounds, so the plan stays shallow however
    many there are.
    """
    types: dict[str, set[str]] = {}
    spelling: dict[str, str] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            types.setdefault(name.lower(), set()).add(kind)
            spelling.setdefault(name.lower(), name)
    mixed = {name for name, kinds in types.items() if len(kinds) > 1}

    def same(name: str) -> Column:
        value = ref(name).cast("string") if name.lower() in mixed else ref(name)
        return value.alias(spelling[name.lower()])

    level = [frame.select(*map(same, frame.columns)) for frame in frames]
    while len(level) > 1:
        paired = [
            a.unionByName(b, allowMissingColumns=True) for a, b in zip(level[::2], level[1::2])
        ]
        level = paired + level[len(paired) * 2 :]
    return level[0] if level else None
