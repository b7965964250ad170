"""Ranks within keys of any size, without one task ever holding one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.session import durable

SHIFT = 33  # monotonically_increasing_id keeps the partition number above the low 33 bits


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with every row's place (from 0) in the order, without one task ever holding all rows.

    The rows are range-sorted and numbered by their place within their task; there is one count per task of
    the sort, a number the session fixes, and these few go to all tasks. The sorted rows are written once, so that places cannot move
    between the passes.
    """
    placed = durable(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_task", F.shiftright("_at", SHIFT))
    counts = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_at").bitwiseAND((1 << SHIFT) - 1)
    return placed.join(F.broadcast(starts), "_task").withColumn(name, F.col("_start") + local).drop("_at", "_task", "_start")


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` for keys that may hold any share of the rows.

    A window would put one key into one task. Here the rows are numbered in the order (keys, order) — a hot key
    then spans many tasks — and the first place of each key is an aggregate with map-side combine. A NULL key is
    a key like any other, as in a window.
    """
    placed = numbered(df, [*keys, *order], "_i")
    firsts = placed.groupBy(*keys).agg(F.min("_i").alias("_first"))
    firsts = firsts.select("_first", *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)))
    same = [placed[k].eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    out = placed.join(firsts, same).drop(*(f"_key{i}" for i in range(len(keys))))
    return out.withColumn(name, (F.col("_i") - F.col("_first") + 1).cast("long")).drop("_i", "_first")


def pinned(df: DataFrame, name: str, value) -> DataFrame:
    """``withColumn`` whose value is computed once per row.

    The optimiser merges projections by reference count and cannot see that a use inside a lambda
    repeats; a one-element explode keeps the value where it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


PUSHED_LIMIT = 1000  # Spark cuts ranked groups before the shuffle up to this limit (window.group.limit.threshold)
SALTS = 64


def first_within(df: DataFrame, by: list[str], order: list, n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows per key with their rank, for keys of any size.

    Small limits are cut by Spark on every task before the shuffle. For larger ones the rows of a key are
    first cut in ``SALTS`` parts, so that the last step sees at most ``SALTS * n`` of them.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    if n > PUSHED_LIMIT:
        part = Window.partitionBy(*by, "_salt").orderBy(*order)
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*by, *order), F.lit(SALTS)))
        df = salted.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
