"""Repeated and nearly repeated lines across documents by deletion neighbourhoods. DataFrame functions only.

A line is a piece of text between line feeds, compared as its sequence of words (runs between ASCII white space). Two
lines are the same if their words are; they are nearly the same if both have ``NEAR_WORDS`` words or more and
one insertion, deletion or replacement of a word turns one into the other. A line is dropped where an earlier one (by
document id, then position) is the same or nearly the same; what remains of a document keeps its order.

1. Every line becomes a row of hashes; equal lines are one class, summed on each task before the shuffle.
2. One edit leaves the first or the last half of a line as it is. Only classes that share a half with another class go
   on; nothing else can have a partner, so nothing is lost.
3. Each of these emits all variants within the bound, itself and itself without one word, as hashed keys with the
   place of the deletion. Lines with equal keys and places differ in that word alone; a line equal to another's
   variant lacks one word. The earliest line of each key is an aggregate, so the lines of a large family are never
   paired with each other.
4. Every class that has an earlier partner is compared with it word by word before it is dropped.

Defined results: null and empty texts, and lines without words, stay as they are; rows that share id and position take the
same place in the order and do not drop each other; a null id comes first; an empty table gives no rows; other
columns are kept, under whatever name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.scale import pinned
from attestra.session import durable

NEAR_WORDS = 8
SENT_ROWS = 1_000_000  # a side of at most so many short rows is sent to every task; a longer one is joined by shuffling
NO_ID = -(2**63)
SPACE = r"[\x20\x09-\x0D]+"


def _words(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda w: w != "")


def _place(doc: Column, pos: Column) -> Column:
    """The order of lines in one number."""
    return (doc.cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)") + pos.cast("decimal(10,0)")).cast("decimal(38,0)")


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    # Id and digest are computed below the explode, so that a line does not carry its whole text.
    cut = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_t"), F.split(text, "\n").alias("lines"))
    rows = cut.select("_id", "_t", F.posexplode("lines").alias("pos", "line"))
    return rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _half(name: str, side: str, long: bool) -> Column:
    """Hash of the first or last half; lines of even length have a shorter half too, for partners of odd length."""
    n = F.size("w")
    h = F.floor(n / 2).cast("int") if long else F.floor((n - 1) / 2).cast("int")
    part = F.slice("w", F.lit(1), h) if side == "first" else F.slice("w", n - h + 1, h)
    wanted = n >= NEAR_WORDS if long else (n >= NEAR_WORDS) & (n % 2 == 0)
    return F.when(wanted, F.xxhash64(F.lit(side), h, part)).alias(name)


def sent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its counted rows (short ones) are few enough."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _t`` (id and text digest) and ``drops``, the positions of the lines that go."""
    lines = _lines(docs, doc_id, text).select("_id", "_t", "pos", _words(F.col("line")).alias("w"))
    rows = lines.select(
        "_id", "_t", "pos", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("again"), "w").alias("h2"), _half("a1", "first", True), _half("a2", "first", False), _half("b1", "last", True), _half("b2", "last", False)
    )
    rows = durable(rows)
    place = _place(F.col("_id"), F.col("pos"))
    halves = [F.min(c).alias(c) for c in ("a1", "a2", "b1", "b2")]
    classes = durable(rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), *halves))
    late = _nearly_repeated(docs, classes, doc_id, text).withColumn("late", F.lit(True))
    repeated = classes.join(late, ["h1", "h2"], "left").select("h1", "h2", "first", "last", F.coalesce("late", F.lit(False)).alias("late"))
    repeated = durable(repeated.filter((F.col("first") < F.col("last")) | F.col("late")).drop("last"))
    gone = rows.select("_id", "_t", "pos", "h1", "h2").join(repeated, ["h1", "h2"]).filter(F.col("late") | (F.col("first") < place))
    return durable(gone.groupBy("_id", "_t").agg(F.collect_set("pos").alias("drops")))


def _nearly_repeated(docs: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``h1, h2`` of the classes that an earlier line is within one edit of."""
    own = classes.select("first", F.explode(F.array_compact(F.array("a1", "a2", "b1", "b2"))).alias("half"))
    shared = own.groupBy("half").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).filter(F.col("lo") < F.col("hi")).select("half")
    wanted = durable(own.join(shared, "half").select("first").distinct())
    lines = _lines(docs, doc_id, text).withColumn("first", _place(F.col("_id"), F.col("pos")))
    known = durable(lines.join(sent(wanted, wanted.count()), "first").select("first", _words(F.col("line")).alias("w")))
    codes = F.unhex(F.array_join(F.transform("w", lambda x: F.lpad(F.hex(F.xxhash64(x)), 16, "0")), ""))
    coded = known.select("first", F.size("w").alias("n"), F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("again"), "w").alias("h2"), codes.alias("c")).filter(F.col("n") >= NEAR_WORDS)
    without = F.concat(F.substring("c", F.lit(1), 8 * F.col("i")), F.substring("c", 8 * F.col("i") + 9, 8 * F.col("n")))
    each = coded.select("*", F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("i"))
    key = F.when(F.col("i") < 0, F.xxhash64("n", "c")).otherwise(F.xxhash64(F.col("n") - 1, without))
    variants = durable(each.select(key.alias("key"), "i", "first", "h1", "h2"))
    groups = durable(variants.groupBy("key", "i").agg(F.min("first").alias("lo"), F.max("first").alias("hi")))
    by_key = groups.groupBy("key").agg(F.min(F.when(F.col("i") < 0, F.col("lo"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("lo"))).alias("cut"))
    by_key = by_key.filter(F.col("whole").isNotNull() & F.col("cut").isNotNull())
    earliest = F.when(F.col("i") < 0, F.col("cut")).otherwise(F.least("lo", "whole"))
    groups = groups.join(by_key, "key", "left").withColumn("earliest", earliest).filter(F.col("earliest") < F.col("hi")).select("key", "i", "earliest")
    found = variants.join(groups, ["key", "i"]).filter(F.col("earliest") < F.col("first"))
    found = found.groupBy("first", "h1", "h2").agg(F.min("earliest").alias("partner"))
    pairs = found.join(known, "first").join(known.select(F.col("first").alias("partner"), F.col("w").alias("v")), "partner")
    return pairs.filter(_one_edit("w", "v")).select("h1", "h2").distinct()


def _one_edit(a: str, b: str) -> Column:
    """Whether two word lists are one edit apart or equal: past their common beginning, they agree but for one word."""
    n, m = F.size(a), F.size(b)
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    at = F.when(differs > 0, differs).otherwise(F.greatest(n, m)).cast("int")
    rest = lambda c, skip: F.slice(c, at + skip, F.greatest(n, m))
    return F.when(n == m, rest(a, 1) == rest(b, 1)).when(n == m + 1, rest(a, 1) == rest(b, 0)).when(m == n + 1, rest(a, 0) == rest(b, 1)).otherwise(False)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` as ``_row``, with ``_text`` (what remains), ``_lines`` and ``_dropped`` (numbers of lines)."""
    drops = dropped_lines(docs, doc_id, text)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    size = drops.agg(F.sum(F.size("drops") + 1)).first()[0] or 0  # a row is as long as its array
    rows = rows.join(sent(drops, size), ["_id", "_t"], "left")
    # Only texts that lose lines are cut, each once.
    rows = pinned(rows, "_cut", F.when(F.col("drops").isNotNull(), F.split("_text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_cut") - 1), F.col("drops"))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at("_cut", i + 1)), "\n")
    count = F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    return rows.select("_row", F.when(F.col("drops").isNull(), F.col("_text")).otherwise(kept).alias("_text"), F.when(F.col("_text").isNull(), 0).otherwise(count).cast("long").alias("_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("_dropped"))
