"""The trie of all conversation prefixes by ROLLUP over positional columns of turn numbers.

Distinct turns (role and text) are sorted into integer numbers. A conversation is a row of positional columns, a block of
them at a time: the first ``FIRST`` turns, then ``NEXT`` turns a block. In each block ``rollup`` over the columns counts all
prefixes together, and ``grouping_id`` tells their lengths. What reaches over a block's end continues in the next block
under the node it has reached; that node is named by its depth and its smallest conversation, because a conversation has
one prefix of each length. Sums over subtrees are the same rollup over the nodes, from the last block back to the first.

Counts and minima are summed on each task before the shuffle, so a turn, prefix or conversation that a third of all
rows share is one row from each task. The list of the conversations that end at a node is never held: sorted ids are
written as pieces of text by many tasks, and one task streams the pieces of a node through the digest.

The rebuilt conversation c begins with the first h turns of conversation c - c % 100, h = crc32(c) % 6, and goes on with its own
turns after the first h.

Defined results: turns with the same number stand in the order of their digests; a null turn number comes first; null
roles and texts are empty; rows without a conversation id belong to no conversation; repeated rows are turns like
any other; a conversation without turns is a member of the root; an empty table gives no rows, not even a root; columns
besides the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.scale import numbered, rank_within
from attestra.session import durable

FIRST, NEXT = 8, 32  # positional columns of the first and of every further block
SHARED_EVERY, SHARED_TURNS = 100, 6
PIECE = 20_000  # ids in one piece of text


def _turns(rows: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1) and the digest of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length of the role keeps (ab, c) and (a, bc) apart.
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    turns = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).alias("chars"))
    return rank_within(turns, ["conv_id"], ["turn", "digest"], "pos").select("conv_id", "pos", "digest", "chars")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``conv_id, pos, turn`` of the rebuilt conversations, ``conv_id, size`` of all, and ``turn, chars`` of distinct turns."""
    turns = durable(_turns(rows))
    known = numbered(turns.groupBy("digest").agg(F.max("chars").alias("chars")), ["digest"], "id")
    known = durable(known)
    turns = durable(turns.join(known.select("digest", "id"), "digest").select("conv_id", "pos", F.col("id").alias("turn")))
    base = (F.col("conv_id") - F.col("conv_id") % SHARED_EVERY).alias("base")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = turns.filter((F.col("pos") < SHARED_TURNS) & (F.col("conv_id") % SHARED_EVERY == 0))
    heads = heads.groupBy("conv_id").agg(*(F.max(F.when(F.col("pos") == i, F.col("turn"))).alias(f"s{i}") for i in range(1, SHARED_TURNS)))
    heads = heads.select(F.col("conv_id").alias("base"), F.array_compact(F.array(*(f"s{i}" for i in range(1, SHARED_TURNS)))).alias("head"))
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    each = own.select("conv_id", "n", base, share.alias("h")).join(heads, "base", "left")
    # slice() of nothing is nothing; a conversation's own turns follow the shared ones that exist.
    each = each.select("conv_id", "n", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<long>")).alias("head"))
    each = durable(each.withColumn("size", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    shared = each.select("conv_id", F.posexplode("head").alias("pos", "turn")).select("conv_id", (F.col("pos") + 1).cast("long").alias("pos"), "turn")
    rest = turns.join(each, "conv_id").filter(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.size("head")).alias("pos"), "turn")
    return shared.union(rest), each.select("conv_id", F.col("size").cast("long").alias("size")), known.select(F.col("id").alias("turn"), "chars")


def _columns(width: int) -> list[str]:
    return [f"t{i}" for i in range(width)]


def _wide(turns: DataFrame, first: int, later: int) -> tuple[DataFrame, DataFrame]:
    """Positional columns: one row per conversation with turns, and one per conversation and further block."""
    at = F.col("pos") - 1
    place = lambda p, width: [F.max(F.when(p == i, F.col("turn"))).alias(c) for i, c in enumerate(_columns(width))]
    head = turns.filter(at < first).groupBy("conv_id").agg(*place(at, first))
    beyond = turns.filter(at >= first).withColumn("block", F.floor((at - first) / later) + 1)
    return head, beyond.groupBy("conv_id", "block").agg(*place((at - first) % later, later))


def _path(columns: list[str]):
    return F.array_compact(F.array(*columns))


def _level(columns: list[str]):
    """Length of the prefix of a rollup's row; a group in which a turn is missing before that is none (null)."""
    width = len(columns)
    gid = F.grouping_id()
    return reduce(lambda otherwise, d: F.when(gid == (1 << (width - d)) - 1, F.lit(d)).otherwise(otherwise), range(width + 1), F.lit(None).cast("int"))


def _rolled(rows: DataFrame, columns: list[str], *sums) -> DataFrame:
    """``key, level, path`` of every prefix with at least one turn, and the root of each key at level 0."""
    out = rows.rollup("key", *columns).agg(_level(["key", *columns]).alias("level"), *sums)
    out = out.withColumn("level", F.col("level") - 1).filter("level >= 0")
    return out.withColumn("path", _path(columns)).filter(F.size("path") == F.col("level")).drop(*columns)


def _nodes(rows: DataFrame, columns: list[str]) -> DataFrame:
    return _rolled(rows, columns, F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))


def trie(conversations: DataFrame, first: int = FIRST, later: int = NEXT) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns, sizes, known = rebuilt(conversations)
    turns, sizes = durable(turns), durable(sizes)
    longest = sizes.agg(F.max("size")).first()[0] or 0
    head, beyond = _wide(turns, first, later)
    beyond = durable(beyond)
    found, parts, at = [], [], 0
    rows = durable(sizes.join(head, "conv_id", "left").withColumn("key", F.lit(0).cast("long")))
    block, width = 0, first
    while True:
        columns = _columns(width)
        nodes = durable(_nodes(rows, columns))
        met = rows.select("conv_id", "size", "key", _path(columns).alias("path"))
        met = durable(met.join(nodes.select("key", "path", F.col("conv_id").alias("node")), ["key", "path"]).select("conv_id", "size", "node"))
        parts.append(met.filter(F.col("size") <= at + width).select("conv_id", F.col("size").alias("depth"), "node"))
        found.append((nodes if block == 0 else nodes.filter("level > 0")).withColumns({"block": F.lit(block), "depth": (F.col("level") + at).cast("long")}))
        at, block, width = at + width, block + 1, later
        if at >= longest:
            break
        on = met.filter(F.col("size") > at).select("conv_id", "size", F.col("node").alias("key"))
        rows = durable(on.join(beyond.filter(F.col("block") == block).drop("block"), "conv_id"))
    nodes = durable(_with_parents(found, first, later, known))
    sums = _subtrees(nodes, block, first, later)
    ends = _ends(reduce(DataFrame.union, parts))
    out = nodes.join(sums, ["depth", "conv_id"]).join(ends, ["depth", "conv_id"], "left")
    none = hashlib.sha256(b"").hexdigest()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*columns, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def _with_parents(found: list[DataFrame], first: int, later: int, known: DataFrame) -> DataFrame:
    """The nodes of all blocks with their parents, numbers of children and what they would save by themselves."""
    nodes = durable(reduce(DataFrame.union, found))
    above = nodes.select("block", "key", F.col("path").alias("over"), F.col("conv_id").alias("parent"))
    inner = nodes.filter("level > 1").withColumn("over", F.slice("path", F.lit(1), F.col("level") - 1)).join(above, ["block", "key", "over"]).drop("over")
    # The first level of a block hangs on the node that the block continues; the first block's on the root.
    top = nodes.filter("level = 1")
    root = nodes.filter("level = 0").select(F.col("conv_id").alias("root"))
    outer = top.filter("block > 0").withColumn("parent", F.col("key")).unionByName(top.filter("block = 0").crossJoin(F.broadcast(root)).withColumnRenamed("root", "parent"))
    whole = inner.unionByName(outer).unionByName(nodes.filter("level = 0").withColumn("parent", F.lit(None).cast("long")))
    whole = durable(whole.withColumn("turn", F.try_element_at("path", F.lit(-1))))
    children = whole.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"))
    out = whole.join(children, ["depth", "conv_id"], "left").join(known, "turn", "left")
    return out.select(
        "block", "key", "level", "path", "depth", "conv_id", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).cast("long").alias("saves"),
    )


def _subtrees(nodes: DataFrame, blocks: int, first: int, later: int) -> DataFrame:
    """``depth, conv_id, n_leaves, saved_tokens``: rollups over the nodes, the last block first."""
    out, below = [], None
    for block in reversed(range(blocks)):
        width, at = (first, 0) if block == 0 else (later, first + (block - 1) * later)
        columns = _columns(width)
        own = nodes.filter(F.col("block") == block).select("key", "level", "path", "conv_id", (F.col("n_children") == 0).cast("long").alias("leaves"), "saves")
        if below is not None:
            carried = below.select(F.lit(width).alias("level"), F.col("key").alias("conv_id"), F.col("n_leaves").alias("more"), F.col("saved_tokens").alias("saved"))
            own = own.join(carried, ["level", "conv_id"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more", F.lit(0)), "saves": F.col("saves") + F.coalesce("saved", F.lit(0))})
        # Position i of a shorter path is null, and so is its group: a node counts for its own prefixes only.
        rows = own.select("key", "conv_id", "leaves", "saves", *(F.get("path", F.lit(i)).alias(c) for i, c in enumerate(columns)))
        # The smallest conversation of a subtree is that of its top.
        sums = durable(_rolled(rows, columns, F.min("conv_id").alias("conv_id"), F.sum("leaves").alias("n_leaves"), F.sum("saves").alias("saved_tokens")))
        out.append(sums.filter("level > 0" if block else "level >= 0").select((F.col("level") + at).cast("long").alias("depth"), "conv_id", "n_leaves", "saved_tokens"))
        below = sums.filter("level = 0")
    return reduce(DataFrame.union, out)


def _ends(members: DataFrame) -> DataFrame:
    """``depth, conv_id, ends_sha256`` of the nodes where conversations end (``conv_id, depth, node``)."""
    rows = durable(members.select("depth", F.col("node"), F.col("conv_id").alias("id")))
    rows = rows.repartitionByRange("depth", "node", "id").sortWithinPartitions("depth", "node", "id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of a node as text, ``PIECE`` at a time; a node may span tasks."""
        top, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"depth": top[0], "node": top[1], "first": ids[0], "ids": ",".join(map(str, ids))}], schema)

        schema = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            for depth, node, i in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if ids and ((depth, node) != top or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                top = depth, node
                ids.append(i)
        if ids:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces come sorted; a node's are joined by commas in the digest alone."""
        top, digest, done = None, None, []
        schema = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids"))):
                if (depth, node) == top:
                    digest.update(b",")
                else:
                    if top is not None:
                        done.append((*top, digest.hexdigest()))
                    top, digest = (depth, node), hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=schema)
                done = []
        if top is not None:
            yield pa.RecordBatch.from_pylist([{"depth": top[0], "conv_id": top[1], "ends_sha256": digest.hexdigest()}], schema)

    text = rows.mapInArrow(pieces, "depth long, node long, first long, ids string")
    text = text.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return text.select("depth", "node", "ids").mapInArrow(digests, "depth long, conv_id long, ends_sha256 string")
