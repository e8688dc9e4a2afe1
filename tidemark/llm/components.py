"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import snapshot


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _low(edges: DataFrame, least) -> DataFrame:
    """``edges`` with the smallest neighbour of each ``u`` (or ``u`` itself) as ``low``.

    The minima are written, so the join has an exchange right below it on both
    sides and Spark can split a node that holds a large share of all edges.
    """
    return edges.join(snapshot(edges.groupBy("u").agg(least.alias("low"))), "u")


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of an edge table (``u``, ``v``); the component is its smallest node.

    Alternates two steps until nothing changes: every node links its larger
    neighbours to the smallest node it knows, then its smaller ones. The number of
    edges never grows and a hub's edges are reduced where they are, so no
    neighbourhood is gathered. Each round is a table in the shared folder. Loops,
    repeated edges and both directions of an edge are fine; edges with a null end
    are left out; no edges give no rows.
    """
    known = edges.filter("u is not null and v is not null and u <> v")
    current = snapshot(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _low(both, F.least(F.min("v"), F.min("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = _low(snapshot(large.distinct()), F.min("v"))
        smaller = small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        current = snapshot(small.select("u", F.col("low").alias("v")).unionByName(smaller).distinct())
        after = _state(current)
        if after == state:
            break
        state = after
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
