"""Tokenisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of word bags, and what separates block tokens.
BAG_SEPARATORS = " .,?!\t"
BLOCK_SEPARATOR = "[^a-z0-9]+"


def block_tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens; every other character separates."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), BLOCK_SEPARATOR)), "")


def words(text: Column) -> Column:
    """Words in order, repeats kept."""
    return F.filter(F.split(text, "[" + BAG_SEPARATORS + "]"), lambda w: w != "")


def blank_words(text: Column) -> Column:
    """Words between blanks, punctuation kept."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def number_repeats(items: Column) -> Column:
    """Turn a bag into a set: the k-th repeat of x (k > 1) becomes ``x.k``.

    One pass over the sorted array: a run starts where the neighbour differs, and
    the distance between starts is the count.
    """
    s = F.array_sort(items)
    packed = F.transform(
        F.array(F.struct(s.alias("s"))),
        lambda b: F.struct(
            b.s.alias("s"),
            F.filter(
                F.when(F.size(b.s) > 0, F.sequence(F.lit(0), F.size(b.s) - 1)).otherwise(F.array().cast("array<int>")),
                lambda i: (i == 0) | (F.get(b.s, i) != F.get(b.s, F.greatest(i - 1, F.lit(0)))),
            ).alias("starts"),
        ),
    )
    runs = F.transform(
        packed,
        lambda b: F.flatten(
            F.transform(
                b.starts,
                lambda at, j: F.transform(
                    F.sequence(F.lit(1), F.coalesce(F.get(b.starts, j + 1), F.size(b.s)) - at),
                    lambda k: F.when(k == 1, F.get(b.s, at)).otherwise(F.concat(F.get(b.s, at), F.lit("."), k.cast("string"))),
                ),
            )
        ),
    )
    return F.get(runs, F.lit(0))


def bag(text: Column) -> Column:
    """Word bag as a set of numbered repeats."""
    return number_repeats(words(text))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_bag(text: Column) -> Column:
    """Character bag as a set of numbered repeats."""
    return number_repeats(chars(text))


def _substrings(text: Column, q: int) -> Column:
    n = F.char_length(text) - q + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(q)))).otherwise(
        F.array().cast("array<string>")
    )


def qgrams(text: Column, q: int = 3) -> Column:
    """Distinct q-grams; blanks squeezed and trimmed, short text padded with ``_``."""
    t = F.trim(F.regexp_replace(text, " {2,}", " "))
    t = F.when(F.char_length(t) < q, F.rpad(t, q, "_")).otherwise(t)
    return F.array_distinct(_substrings(t, q))


def plain_grams(text: Column, q: int = 2) -> Column:
    """Plain q-grams in order, repeats kept."""
    return _substrings(text, q)


def gram_bag(text: Column, q: int = 2) -> Column:
    """Bag of plain q-grams, numbered repeats (for edit distance)."""
    return number_repeats(_substrings(text, q))


def padded_bigrams(text: Column) -> Column:
    """Distinct 2-grams with two blanks on both sides."""
    return F.array_distinct(_substrings(F.concat(F.lit("  "), text, F.lit("  ")), 2))
