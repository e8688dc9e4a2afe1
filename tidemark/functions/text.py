"""Name normalization and similarity, all with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that do not count when two names are compared.
SEPARATORS = " -_/."
_BLANKS = " " * (len(SEPARATORS) - 1)


def normalize_key(value: Column) -> Column:
    """Lower-case name without separators; '' for null."""
    return F.lower(F.translate(F.coalesce(value, F.lit("")), SEPARATORS, ""))


def normalize_text(value: str | None) -> str:
    """:func:`normalize_key` for a single parameter value."""
    return (value or "").lower().translate({ord(c): None for c in SEPARATORS})


def tokens(value: Column) -> Column:
    """Distinct lower-case words of a name, split at separators."""
    spaced = F.translate(F.lower(F.coalesce(value, F.lit(""))), SEPARATORS.strip(), _BLANKS)
    return F.array_distinct(F.filter(F.split(spaced, r"\s+"), lambda word: word != F.lit("")))


def token_overlap(left: Column, right: Column) -> Column:
    """Jaccard overlap of the words of two names, 0 when either has none."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    union = F.size(F.array_union(left, right)).cast("double")
    return F.when((F.size(left) > 0) & (F.size(right) > 0), shared / union).otherwise(F.lit(0.0))


def name_similarity(left: Column, right: Column) -> Column:
    """Score in 0..1 of two names.

    1 when equal after normalization; otherwise the larger of the length ratio
    (when one contains the other) and the word overlap.
    """
    a, b = normalize_key(left), normalize_key(right)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    contained = F.when(F.contains(a, b) | F.contains(b, a), short.cast("double") / long.cast("double"))
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(F.greatest(F.coalesce(contained, F.lit(0.0)), token_overlap(tokens(left), tokens(right))))
    )


def filled(value: Column, default: str = "") -> Column:
    """``value``, or ``default`` when it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
