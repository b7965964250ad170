"""Exact duplicates by deterministic block naming. DataFrame functions only.

A text, with every run of ASCII white space as one space, is cut into blocks of ``BLOCK`` code points. All distinct
blocks of the corpus are sorted and their places are their integer names; then neighbouring names of a document are
paired, the distinct pairs are sorted into names of the next level, and so on until a document has one name. Equal names
of a level mean equal texts: a pair of integers is compared exactly, and so are blocks.

1. The order of blocks is that of their 64-bit hashes, then of their contents. Only one pass moves contents: it counts
   the distinct contents of every hash, summed on each task before the shuffle. A hash with one content stands for it;
   where contents share a hash, they are numbered within it and such blocks are met by content.
2. From there on all rows are a few integers. A level names half as many pairs as the one before, and a document leaves
   as soon as it has one name, so the work after the first level is that of the long documents alone.
3. A name that many rows share (a common block, a group of copies) is one row in the sort and a key of a join that
   Spark splits; no group is gathered.

Defined results: a null text counts as empty; an empty text is one empty block, so all of them are one group; a row with
an id stays before rows without one, then the smallest id; of rows that repeat with id and text exactly one stays; an empty
table gives no rows; columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.scale import numbered
from attestra.session import durable

BLOCK = 4096  # code points
#: Where white space is not one space already; replacing only these gives the same text as replacing every run.
OTHER_SPACE = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), OTHER_SPACE, " ")


def blocks(text: Column, size: int = BLOCK) -> Column:
    """The normalised text in pieces of ``size`` code points; the empty text is one empty piece."""
    normal = normalised(text)
    return F.when(normal == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(normal, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _contents(docs: DataFrame, text: str, size: int, digest: Callable) -> DataFrame:
    each = docs.select(F.explode(blocks(F.col(text), size)).alias("block"))
    return each.select(digest(F.col("block")).alias("h"), "block")


def named(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK, digest: Callable = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: ``row`` (unique), ``doc_id``, ``text_sha256`` and the identity ``level, name``."""
    contents = _contents(docs, text, size, digest)
    codes = durable(contents.distinct().groupBy("h").agg(F.count("*").alias("n")))
    clashes = codes.filter("n > 1").select("h")
    cut = blocks(F.col(text), size)
    head = [F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256")]
    if clashes.isEmpty():
        rows = durable(docs.select(*head, F.transform(cut, lambda block: digest(block)).alias("hs")))
        at = rows.select("row", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "l")).withColumn("r", F.lit(1).cast("long"))
    else:
        inside = contents.join(clashes, "h").distinct()
        order = numbered(inside, ["h", "block"], "place")
        first = order.groupBy("h").agg(F.min("place").alias("first"))
        order = durable(order.join(first, "h").select("h", "block", (F.col("place") - F.col("first") + 1).alias("r")))
        texts = durable(docs.select(*head, cut.alias("blocks")))
        rows = texts.drop("blocks")
        each = texts.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block")).withColumn("h", digest(F.col("block")))
        at = durable(each.join(order, ["h", "block"], "left").select("row", "n", "pos", F.col("h").alias("l"), F.coalesce("r", F.lit(1)).cast("long").alias("r")))
    found = _identities(at)
    return durable(rows.select("row", "doc_id", "text_sha256").join(found, "row"))


def _identities(at: DataFrame) -> DataFrame:
    """``row, level, name`` from the rows ``row, n, pos, l, r``: the pair (l, r) at place ``pos`` of ``n`` in a document."""
    levels = max((at.agg(F.max("n")).first()[0] or 1) - 1, 0).bit_length()
    done = []
    for level in range(levels + 1):
        names = numbered(at.select("l", "r").distinct(), ["l", "r"], "name")
        now = at.join(names, ["l", "r"]).select("row", "n", "pos", (F.col("name") + 1).alias("name"))
        now = durable(now)
        done.append(now.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        pick = lambda side: F.coalesce(F.max(F.when(F.col("pos") % 2 == side, F.col("name"))), F.lit(0).cast("long"))
        pairs = now.filter("n > 1").groupBy("row", F.shiftright("pos", 1).alias("at"), F.shiftright(F.col("n") + 1, 1).alias("left"))
        at = pairs.agg(pick(0).alias("l"), pick(1).alias("r")).select("row", F.col("left").alias("n"), F.col("at").alias("pos"), "l", "r")
    return reduce(DataFrame.union, done)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK, digest: Callable = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = named(docs, doc_id, text, size, digest)
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "row")).alias("best")
    groups = rows.groupBy("level", "name").agg(best, F.count("*").alias("group_size")).filter("group_size > 1")
    groups = durable(groups.select("level", "name", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("first")))
    out = rows.join(groups, ["level", "name"], "left")
    alone = F.col("first").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows with the same id and text, any one stays."""
    judged = durable(exact_duplicates(docs, doc_id, text).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"))
    pairs = judged.groupBy("_id", "_sha").agg(F.count("*").alias("_n"), F.max("kept").alias("_kept"))
    pairs = durable(pairs.filter("NOT _kept OR _n > 1").withColumnsRenamed({"_id": "_a", "_sha": "_b"}))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.col(doc_id).alias("_id"), F.sha2(normalised(F.col(text)), 256).alias("_sha"))
    rows = rows.join(pairs, F.col("_id").eqNullSafe(F.col("_a")) & (F.col("_sha") == F.col("_b")), "left")
    single = rows.filter(F.col("_kept").isNull()).select("_row")
    repeated = rows.filter("_kept AND _n > 1").dropDuplicates(["_id", "_sha"]).select("_row")
    return single.union(repeated).select("_row.*")
