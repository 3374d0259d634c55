"""String damage used by the error injector.  None of these raises; text without a match is unchanged."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spelling variants in order of precedence; the first one that changes the text wins.
SPELLING_RULES = (
    ("SS", "Ç"),
    ("Ç", "SS"),
    ("Z", "S"),
    ("K", "C"),
    ("TH", "T"),
    ("EI", "E"),
    ("ANA", "ANNA"),
    ("DE ", ""),
    ("RR", "R"),
    ("Y", "I"),
    ("W", "U"),
)

DATE_READ = "d/M/yyyy"
DATE_WRITE = "dd/MM/yyyy"


def suppressed() -> Column:
    """A suppressed value is the empty text, not null: it still sets the bits of its pad bigram."""
    return F.lit("")


def drop_second_word(z: Column) -> Column:
    return F.regexp_replace(z, "^([^ ]*) [^ ]*", "$1")


def abbreviate_first(z: Column, mode: str = "literal") -> Column:
    """First word to its initial.

    ``literal`` keeps only the initial (the rest survives just after a leading blank); ``intended`` keeps
    the remaining words.
    """
    initial = F.upper(F.substring(z, 1, 1))
    if mode == "literal":
        tail = F.when(z.startswith(" "), z.substr(F.lit(2), F.length(z))).otherwise(F.lit(""))
        return F.when(z == "", z).otherwise(F.concat(initial, F.lit(". "), tail))
    if mode == "intended":
        rest = F.regexp_extract(z, "(?s)^[^ ]*(.*)$", 1)
        return F.when(z == "", z).otherwise(F.concat(initial, F.lit("."), rest))
    raise ValueError(f"unknown abbreviation mode {mode!r}")


def abbreviate_second(z: Column) -> Column:
    shape = "(?s)^([^ ]*) (.)([^ ]*)(.*)$"
    short = F.concat(
        F.regexp_extract(z, shape, 1),
        F.lit(" "),
        F.upper(F.regexp_extract(z, shape, 2)),
        F.lit("."),
        F.regexp_extract(z, shape, 4),
    )
    return F.when(z.rlike(shape), short).otherwise(z)


def spelling_variant(z: Column) -> Column:
    result = z
    for found, instead in reversed(SPELLING_RULES):
        result = F.when(z.contains(found), F.replace(z, F.lit(found), F.lit(instead))).otherwise(result)
    return result


def shift_code(z: Column, noise: Column) -> Column:
    """Numeric category plus noise, as text."""
    return F.coalesce((z.try_cast("bigint") + noise).cast("string"), z.cast("string"))


def shift_date(z: Column, days: Column) -> Column:
    moved = F.date_add(F.try_to_date(z, DATE_READ), days.cast("int"))
    return F.coalesce(F.date_format(moved, DATE_WRITE), z)
