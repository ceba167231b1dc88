"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(x, F.lit("_"), F.lit(" "))), r"\s+", " "))


def normalize_context(x: Column) -> Column:
    """As ``normalize_text``, but a trailing blank stays as one space."""
    plain = normalize_text(x)
    return F.when(F.replace(x, F.lit("_"), F.lit(" ")).rlike(r"\s$") & (plain != ""), F.concat(plain, F.lit(" "))).otherwise(plain)


def partial_word(context: Column) -> Column:
    """The last, perhaps unfinished word of a context; empty after a blank."""
    return F.element_at(F.split(context, " "), -1)


def context_suffixes(context: Column) -> Column:
    """All suffixes that start at a word, longest first, without repeats."""
    words = F.split(context, " ")
    tails = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    return F.array_distinct(F.filter(tails, lambda s: s != ""))


def hash_percent(x: Column, salt: str) -> Column:
    """SHA-256 of ``salt:x`` as a number, modulo 100, digit by digit."""
    digits = F.transform(F.split(F.sha2(F.concat(F.lit(salt + ":"), x), 256), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 16 + d) % 100)
