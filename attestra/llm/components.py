"""Connected components of a table of links, without any node's links in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.session import durable


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``: long); the label is the smallest node reachable.

    Large star and small star in turn: every node's links are rehung on its smallest neighbour until nothing
    changes, after a number of rounds that grows with the logarithm of the longest path. A node's smallest
    neighbour is an aggregate with map-side combine; the join after it splits a node of many links by itself.
    Each round is a written table, so a lost executor repeats one round at most.
    """
    edges = durable(_between(links, "a", "b"))
    state = None
    while True:
        edges = _star(_star(edges, True), False)
        edges = durable(edges)
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        now = (row["n"], row["sum"])
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(edges.select(F.col("b"), F.col("b")).distinct())


def _between(df: DataFrame, a: str, b: str) -> DataFrame:
    """Links as (larger, smaller) without loops and repeats."""
    low, high = F.least(a, b).alias("b"), F.greatest(a, b).alias("a")
    return df.filter(F.col(a) != F.col(b)).select(high, low).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` hold (larger, smaller). Large: neighbours above a node go to its smallest; small: the others do."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    else:
        down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).union(low.select("u", "m"))
    return _between(hung, "x", "y")
