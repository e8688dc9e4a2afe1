"""Pairs of similar names without comparing every name with every other one.

A pair can only reach the threshold when the shorter normalized name is contained
in the longer one and long enough, or when their words overlap enough. Either case
is an equality join whose rows per name grow with the length of the name:

* A longer name of n characters is looked up by its windows of p = threshold * n
  characters, of which there are n - p + 1; a shorter name by its beginnings of every
  length p that a longer name can ask for. If it is contained, its beginning of that
  length is one of the windows, so the key is most of either name.
* Of a name's words only the rarest few are looked up, because two sets that
  overlap that much must share one of them. Words that occur in very many names
  therefore form no join group, and where words meet their frequencies, the very
  frequent ones (a thousand at most) are a broadcast of their own.

The candidates are then scored exactly, so the result is the one that a
comparison of all pairs would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import name_similarity, normalize_key, tokens
from tidemark.session import snapshot

# Keeps a product such as 0.72 * 25 from being rounded up past its exact value.
_EPSILON = 1e-9
# A word is frequent from this share of all words on; the shares add up to one, so there are no more than its inverse.
FREQUENT = 1_000


def _at_least(size: Column, threshold: float) -> Column:
    """Smallest whole number that is at least ``threshold`` of ``size``."""
    return F.ceil(size * threshold - _EPSILON).cast("int")


def _windows(key: Column, threshold: float) -> Column:
    """(length, hash) of the windows by which a longer name is found."""
    size = F.greatest(_at_least(F.length(key), threshold), F.lit(1))
    starts = F.sequence(F.lit(1), F.length(key) - size + 1)
    return F.array_distinct(F.transform(starts, lambda at: F.struct(size.alias("size"), F.xxhash64(F.substring(key, at, size)).alias("hash"))))


def _beginnings(key: Column, threshold: float) -> Column:
    """(length, hash) of the beginnings by which a shorter name is found."""
    sizes = F.sequence(F.greatest(_at_least(F.length(key), threshold), F.lit(1)), F.length(key))
    return F.transform(sizes, lambda size: F.struct(size.alias("size"), F.xxhash64(F.substring(key, F.lit(1), size)).alias("hash")))


def _tagged(parts: Column, kind: int) -> Column:
    return F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), x["size"].alias("size"), x["hash"].alias("hash")))


def _contained(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs in which one normalized name can be a long enough part of the other."""

    def keys(side: str, name: str) -> DataFrame:
        # Kind 0 finds pairs whose left name is the longer one, kind 1 those whose right name is.
        of_side = names.filter((F.col("side") == side) & (F.col("key") != ""))
        as_longer, as_shorter = (0, 1) if side == "left" else (1, 0)
        tagged = F.concat(_tagged(_windows(F.col("key"), threshold), as_longer), _tagged(_beginnings(F.col("key"), threshold), as_shorter))
        return of_side.select(F.col("name").alias(name), F.explode(tagged).alias("k")).select(name, "k.*")

    return keys("left", "left_name").join(keys("right", "right_name"), ["kind", "size", "hash"]).select("left_name", "right_name")


def _overlapping(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share one of their rare words."""
    words = names.select("side", "name", F.explode("words").alias("word"))
    frequency = snapshot(words.groupBy("word").agg(F.count(F.lit(1)).alias("names")))
    least = frequency.select(F.sum("names") / FREQUENT).scalar()
    frequent = F.broadcast(frequency.filter(F.col("names") >= least))
    rare = frequency.filter(F.col("names") < least)
    weighed = words.join(frequent, "word").unionByName(words.join(frequent, "word", "left_anti").join(rare, "word"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("names", "word"))), lambda w: w["word"])
    ranked = weighed.groupBy("side", "name").agg(ordered.alias("words"))
    needed = F.size("words") - _at_least(F.size("words"), threshold) + 1
    looked_up = snapshot(ranked.select("side", "name", F.explode(F.slice("words", F.lit(1), needed)).alias("word")))
    left = looked_up.filter("side = 'left'").select(F.col("name").alias("left_name"), "word")
    right = looked_up.filter("side = 'right'").select(F.col("name").alias("right_name"), "word")
    return left.join(right, "word").select("left_name", "right_name")


def similar_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``left_name, right_name, score`` of all pairs that reach ``threshold``.

    Both inputs have one column of names; a name that occurs often counts once. The
    names and the pairs are written once, so the inputs are read once.
    """
    sides = [
        df.select(F.lit(side).alias("side"), F.col(df.columns[0]).alias("name")).filter("name IS NOT NULL").distinct()
        for side, df in (("left", left), ("right", right))
    ]
    name = F.col("name")
    names = snapshot(sides[0].unionByName(sides[1]).select("side", "name", normalize_key(name).alias("key"), tokens(name).alias("words")))
    candidates = _contained(names, threshold).unionByName(_overlapping(names, threshold))
    scored = candidates.distinct().withColumn("score", name_similarity(F.col("left_name"), F.col("right_name")))
    return snapshot(scored.filter(F.col("score") >= threshold))
