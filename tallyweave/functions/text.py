"""Names, titles, file names and codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A code that cannot be read counts as September 2017.
DEFAULT_YEAR = 2017
DEFAULT_MONTH = 9

# White space in the two title forms. All that Unicode counts lies below U+3001.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
NARROW_WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32)))

LENGTH_GAP = 10
FAR_APART = 999


def clean_name(name: Column) -> Column:
    """Join key of a person's name: blanks at the ends and letter case are ignored."""
    return F.lower(F.trim(name))


def _letters_and_blanks(text: Column, white: str) -> Column:
    """ASCII letters and digits with single blanks for white space; the rest dropped.

    ASCII is settled by translate and the rest by one plain class, since regular
    expressions that exclude several ranges slow down when many tasks share a JVM.
    """
    ascii_rest = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c not in white)
    plain = F.translate(text, white + ascii_rest, " " * len(white))
    return F.regexp_replace(F.regexp_replace(plain, r"\P{ASCII}+", ""), " {2,}", " ")


def strict_title(title: Column) -> Column:
    """Title key that trims first, so dropped characters may leave a blank at either end."""
    return F.lower(_letters_and_blanks(F.trim(title), NARROW_WHITE))


def loose_title(title: Column) -> Column:
    """Title key that trims last. NULL stays NULL."""
    return F.trim(_letters_and_blanks(F.lower(title), WHITE))


TITLE_KEYS = {"loose": loose_title, "strict": strict_title}


def usable(key: Column) -> Column:
    """Whether a normalised key may take part in a match: neither NULL nor blank."""
    return F.coalesce(F.trim(key) != "", F.lit(False))


def usable_keys(key: Column) -> Column:
    """The key as a list of one, or none if it may not take part in a match.

    Exploding the list gives the key and drops or blanks the others, with the key
    worked out once: a filter on it would be moved below and work it out again.
    """
    return F.filter(F.array(key), usable)


def words(text: Column, longer_than: int = 0) -> Column:
    """The words of a normalised text that have more than ``longer_than`` characters."""
    return F.filter(F.split(text, " "), lambda w: F.length(w) > longer_than)


def edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance; 999 when the lengths are more than ten apart."""
    gap = F.abs(F.length(left) - F.length(right))
    return F.when(gap > LENGTH_GAP, F.lit(FAR_APART)).otherwise(F.levenshtein(left, right))


def code_year_month(code: Column) -> Column:
    """Year and month at the head of a competition code, both defaulted if unreadable."""
    readable = F.coalesce(code.rlike("^[0-9]{6}"), F.lit(False))
    year = F.when(readable, F.substring(code, 1, 4).try_cast("int"))
    month = F.when(readable, F.substring(code, 5, 2).try_cast("int"))
    return F.struct(
        F.coalesce(year, F.lit(DEFAULT_YEAR)).alias("year"),
        F.coalesce(month, F.lit(DEFAULT_MONTH)).alias("month"),
    )


def grant_date(code: Column) -> Column:
    """``YYYY-MM`` of a competition code."""
    parsed = code_year_month(code)
    return F.format_string("%d-%02d", parsed["year"], parsed["month"])


def fiscal_year_of_file(file_name: Column) -> Column:
    """``..._201011.csv`` gives ``2010-11``; a name without six digits there ``Unknown``."""
    stem = F.substring_index(F.substring_index(file_name, "_", -1), ".", 1)
    year = F.concat(F.substring(stem, 1, 4), F.lit("-"), F.substring(stem, 5, 2))
    return F.when(stem.rlike("^[0-9]{6}"), year).otherwise(F.lit("Unknown"))


def fiscal_year_of_table(table_name: Column) -> Column:
    """``grants_2010_11`` gives ``2010-11``; a name without numbers gives ``Unknown``."""
    numbers = F.filter(F.split(table_name, "_"), lambda part: part.rlike("^[0-9]+$"))
    return F.coalesce(F.nullif(F.array_join(numbers, "-"), F.lit("")), F.lit("Unknown"))


def file_slug(name: Column) -> Column:
    """File-name form of a person's name: blanks become ``_`` and commas go."""
    return F.translate(name, " ,", "_")


def record_id(name: Column, title: Column) -> Column:
    """``Name_Title`` as text; a missing part reads ``nan``."""
    missing = F.lit("nan")
    return F.concat(F.coalesce(name, missing), F.lit("_"), F.coalesce(title, missing))
