"""Greedy packing of consecutive items into groups of bounded size, for sequences of any length.

Rule: an item opens a new group when it must (``opens``), when the item before closed its group
(``closes``), or when the group's size plus its own would pass the limit; a group's size counts one
extra for each item. Whether an item opens a group depends on everything before it, so sequences are
cut into tiles. Sequences within one tile — nearly all — are folded in one step. Longer ones take two
passes: each tile is summarised as a function from the size it is entered with to the size it is left
with, these are composed along the sequence, and every tile is then folded from its true start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.session import ships_with_job

ships_with_job(__name__)

TILE = 1024


def tile_exits(pos: np.ndarray, sizes: np.ndarray, opens: np.ndarray, closes: np.ndarray, limit: int) -> list[list[int]]:
    """Ways through a tile as rows [entered above, exit size, start of the group left open, grows].

    The entry size only decides which item is the first to open a group; from there the way is fixed.
    Rows are tried in order; the first whose bound is below the entry size holds. A row that grows
    passes the entered group through, larger by the exit size. Size -1 stands for no open group; row 0
    is the way for that.
    """
    n = len(sizes)
    cum = np.concatenate([[0], np.cumsum(sizes + 1)])
    forced = opens | np.concatenate([[False], closes[:-1]])
    next_forced = np.full(n + 1, n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        next_forced[i] = i if forced[i] else next_forced[i + 1]
    # item j does not fit a group opened at i when the sizes of i..j-1, each plus one, plus its own pass the limit
    fits_until = np.searchsorted(cum[1:] - 1, limit + cum[:-1], side="right")
    shut = bool(closes[n - 1])
    left, start = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        j = min(max(i + 1, int(fits_until[i])), int(next_forced[i + 1]))
        if j >= n:
            left[i], start[i] = (-1 if shut else cum[n] - cum[i]), pos[i]
        else:
            left[i], start[i] = left[j], start[j]
    rows = [[-2, int(left[0]), int(start[0]), 0]]
    bound = int(next_forced[0])
    for j in range(bound):
        top = limit + 1 - int(cum[j + 1])
        rows.append([top, int(left[j]), int(start[j]), 0])
        if top < 0:
            return rows
    if bound < n:
        rows.append([-1, int(left[bound]), int(start[bound]), 0])
    else:
        rows.append([-1, -1 if shut else int(cum[n]), -1, 0 if shut else 1])
    return rows


def leave(rows: list[list[int]], size: int, start: int) -> tuple[int, int]:
    """(size, start) of the group left open by a tile entered with an open group of that size and start."""
    for top, out, first, grows in rows[:1] if size < 0 else rows[1:]:
        if size > top:
            return (size + out, start) if grows else (out, first)
    raise ValueError("no way through the tile")


def _summaries(limit: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        ways = tile_exits(
            pdf["_pos"].to_numpy(np.int64),
            pdf["_size"].to_numpy(np.int64),
            pdf["_opens"].to_numpy(bool),
            pdf["_closes"].to_numpy(bool),
            limit,
        )
        return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "_tile": [pdf["_tile"].iloc[0]], "ways": [ways]})

    return run


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_tile")
    size, start, sizes, starts = -1, -1, [], []
    for ways in pdf["ways"]:
        sizes.append(size)
        starts.append(start)
        size, start = leave([list(w) for w in ways], size, start)
    return pd.DataFrame({"_key": pdf["_key"], "_tile": pdf["_tile"], "in_size": sizes, "in_start": starts})


def pack(
    items: DataFrame, key: str, pos: str, size: str, limit: int, total: str, opens=None, closes=None, carry=()
) -> DataFrame:
    """Items with ``start``: the position of the first item of their group.

    ``pos`` orders the items of a key from 0 (gaps are fine), ``total`` is above every position of the
    key; both decide only how the work is cut. Returns key, pos, start and the carried columns.
    """
    none = F.lit(False)
    base = items.select(
        F.col(key).alias("_key"),
        F.col(pos).cast("long").alias("_pos"),
        F.floor(F.col(pos) / TILE).cast("long").alias("_tile"),
        F.col(size).cast("long").alias("_size"),
        F.coalesce(opens if opens is not None else none, none).alias("_opens"),
        F.coalesce(closes if closes is not None else none, none).alias("_closes"),
        F.col(total).cast("long").alias("_total"),
        *carry,
    )
    key_type = base.schema["_key"].dataType.simpleString()
    light = base.filter(F.col("_total") > TILE).select("_key", "_pos", "_tile", "_size", "_opens", "_closes")
    tiles = light.groupBy("_key", "_tile").applyInPandas(
        _summaries(limit), f"_key {key_type}, _tile long, ways array<array<long>>"
    )
    entries = tiles.groupBy("_key").applyInPandas(
        _compose, f"_key {key_type}, _tile long, in_size long, in_start long"
    )
    member = F.struct("_pos", "_size", "_opens", "_closes", *carry)
    cut = base.groupBy("_key", "_tile").agg(
        F.array_sort(F.collect_list(member), lambda a, b: F.sign(a["_pos"] - b["_pos"]).cast("int")).alias("ms")
    )
    cut = cut.join(entries, ["_key", "_tile"], "left")
    state = "struct<size:bigint,start:bigint,out:array<bigint>>"

    def step(acc, m):
        fresh = (acc["size"] < 0) | m["_opens"] | (acc["size"] + m["_size"] > limit)
        grown = F.when(fresh, 0).otherwise(acc["size"]) + m["_size"] + 1
        first = F.when(fresh, m["_pos"]).otherwise(acc["start"])
        return F.struct(
            F.when(m["_closes"], -1).otherwise(grown).alias("size"),
            first.alias("start"),
            F.concat(acc["out"], F.array(first)).alias("out"),
        ).cast(state)

    zero = F.struct(
        F.coalesce("in_size", F.lit(-1)).alias("size"),
        F.coalesce("in_start", F.lit(-1)).alias("start"),
        F.array().cast("array<bigint>").alias("out"),
    ).cast(state)
    folded = cut.select("_key", "ms", F.aggregate("ms", zero, step)["out"].alias("starts"))
    flat = folded.select("_key", F.explode(F.arrays_zip("ms", "starts")).alias("z"))
    return flat.select(
        F.col("_key").alias(key),
        F.col("z.ms._pos").alias(pos),
        F.col("z.starts").alias("start"),
        *[F.col(f"z.ms.{c}").alias(c) for c in carry],
    )
