"""Near-duplicate documents by MinHash with tensored banding.

Words are runs between ASCII white space, lower-cased A-Z; a document's set is its distinct shingles of ``width``
words. Two small collections of ``ROWS``-fold minhash signatures are computed, ``TABLES`` each; every table key
of the banding joins one signature of the first collection with one of the second, so that ``TABLES``² tables of
``2 * ROWS`` rows cost ``2 * TABLES * ROWS`` minhashes. A pair at the threshold of 0.8 shares no key with a
probability of 2 * (1 - 0.8³)¹⁶ = 2e-5; pairs above it less often.

From keys to links without the pairs of a group:

1. documents with equal sets are one class, which goes on as its smallest id;
2. a signature that no other class has is dropped before the collections are combined (its keys are its own);
3. in every key's group, each class is compared with the smallest one (a star), on full sets;
4. where a group still holds classes of different components, they are compared with another member, and then go
   through an exact prefix join: sets that are similar enough share one of their rarest shingles, and only
   pairs of different components that do are compared. No link between components is lost, and a passage
   that many documents share, being frequent, is no one's rarest shingle.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer
words than ``width`` make one shingle; a null id is reported with a null component and kept; rows that share an id
are one document with several texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.components import components
from attestra.llm.line_dedup import sent
from attestra.session import durable

TABLES, ROWS = 16, 3
PERCENT = 80  # similarity a link needs
COLUMNS = 8192  # shingles that are hashed at once

_rng = np.random.default_rng(20240601)
_XOR = _rng.integers(0, 2**64, 2 * TABLES * ROWS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**64, 2 * TABLES * ROWS, dtype=np.uint64) | np.uint64(1)
_SLOT = _rng.integers(0, 2**64, 2 * TABLES, dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes: A-Z and ASCII spaces only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    with np.errstate(over="ignore"):
        m = max(n - width + 1, 1)
        out = np.full(m, n if n < width else width, np.uint64)
        for k in range(min(width, n)):
            out = out * _STEP + h[k : k + m]
        return np.unique(_mixed(out))


def signatures(shingles: np.ndarray) -> np.ndarray:
    """The signatures of both collections, one 64-bit number each."""
    with np.errstate(over="ignore"):
        low = np.full(len(_XOR), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), COLUMNS):
            part = (shingles[None, at : at + COLUMNS] ^ _XOR[:, None]) * _MUL[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        low = low.reshape(2 * TABLES, ROWS)
        out = _SLOT.copy()
        for k in range(ROWS):
            out = _mixed(out * _STEP + low[:, k])
        return out


def sketched(text: str, width: int) -> Column:
    """Struct ``n`` (set size), ``s1, s2`` (digest of the set) and ``sig`` (signatures, first collection first)."""
    kind = T.StructType(
        [T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))]
    )

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingle_set(t, width)
            raw = s.tobytes()
            digest = np.array([xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw)], np.uint64).view(np.int64)
            rows.append((len(s), int(digest[0]), int(digest[1]), signatures(s).view(np.int64) if len(s) else None))
        return pd.DataFrame(rows, columns=["n", "s1", "s2", "sig"])

    return F.pandas_udf(run, kind)(text)


def full_set(text: str, width: int) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).view(np.int64) for t in texts])

    return F.pandas_udf(run, T.ArrayType(T.LongType()))(text)


def near_duplicates(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), sketched(text, width).alias("k")).select("doc_id", "k.*")
    rows = durable(rows)
    some = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # 1. classes of equal sets; those of one document need no row here
    classes = some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    classes = durable(classes.filter(F.col("rep") < F.col("last")).select("s1", "s2", "n", "rep"))
    members = some.join(classes, ["s1", "s2", "n"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    reps = members.filter(F.col("rep") == F.col("doc_id")).select("rep", F.col("n").cast("int").alias("n"), "sig")
    keys = _table_keys(reps)
    sets = durable(_sets(docs, keys.select("rep").distinct(), width, doc_id, text))
    # 3. stars
    hubs = keys.groupBy("key").agg(F.min("rep").alias("b"), F.min_by("n", "rep").alias("m"))
    stars = keys.join(hubs, "key").filter(F.col("rep") != F.col("b"))
    links = durable(_similar(stars.select(F.col("rep").alias("a"), "n", "b", "m"), sets))
    labels = durable(components(links))
    # 4. what stars leave open: once more with other hubs, then exactly
    for rest in (_other_stars, _open_pairs):
        found = durable(_similar(rest(keys, labels, sets), sets))
        if not found.isEmpty():
            links = links.union(found)
            labels = durable(components(links))
    owner = members.select("doc_id", "s1", "s2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    linked = owner.select("doc_id", "s1", "s2", F.coalesce("label", "rep").alias("component_id")).filter("component_id <> doc_id").distinct()
    out = rows.join(linked, ["doc_id", "s1", "s2"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def _table_keys(reps: DataFrame) -> DataFrame:
    """``rep, n, key``: the combined keys that at least two classes have."""
    own = reps.select("rep", "n", F.posexplode("sig").alias("slot", "s")).select("rep", "n", (F.col("slot") < TABLES).alias("first"), "s")
    shared = _in_two(own, "s")
    shared = own.join(shared, "s").groupBy("rep", "n").agg(
        F.collect_set(F.when(F.col("first"), F.col("s"))).alias("u"), F.collect_set(F.when(~F.col("first"), F.col("s"))).alias("v")
    )
    pairs = shared.select("rep", "n", F.explode("u").alias("x"), "v").select("rep", "n", "x", F.explode("v").alias("y"))
    keys = durable(pairs.select("rep", "n", F.xxhash64("x", "y").alias("key")))
    return durable(keys.join(_in_two(keys, "key"), "key").select("rep", "n", "key"))


def _in_two(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur with two different ``rep``; counted on each task before the shuffle."""
    span = df.groupBy(key).agg(F.min("rep").alias("_low"), F.max("rep").alias("_high"))
    return span.filter(F.col("_low") < F.col("_high")).select(key)


def _sets(docs: DataFrame, wanted: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    wanted = durable(wanted)
    found = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("_text")).join(sent(wanted, wanted.count()), "rep", "left_semi")
    return found.select("rep", full_set("_text", width).alias("set")).withColumn("n", F.size("set"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` (with sizes ``n, m``) whose full sets are similar enough. Sizes are compared before the sets are fetched."""
    near = pairs.filter(100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")).select("a", "b").distinct()
    near = near.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return near.filter(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _in_mixed(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, rep, n, label`` of the groups that hold more than one component."""
    labelled = keys.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = durable(labelled.select("key", "rep", "n", "label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter(F.col("_low") < F.col("_high"))
    return labelled.join(mixed.select("key"), "key")


def _other_stars(keys: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """In every mixed group, the hubs that come first in two orders by chance, and the members of other components than theirs.

    The orders serve all groups, so that the many groups of one family share few hubs; a member of such groups is one row for
    both its hubs as soon as they have met.
    """
    mixed = durable(_in_mixed(keys, labels))
    order = lambda k: F.xxhash64(F.lit(k), "rep")
    hubs = mixed.groupBy("key").agg(*(F.min_by(c, order(k)).alias(f"{c}{k}") for k in (1, 2) for c in ("rep", "label", "n")))
    other = (F.col("label") != F.col("label1")) | (F.col("label") != F.col("label2"))
    met = mixed.join(hubs, "key").filter(other).drop("key").distinct()
    both = F.array(*(F.struct(F.col(f"rep{k}").alias("b"), F.col(f"label{k}").alias("lb"), F.col(f"n{k}").alias("m")) for k in (1, 2)))
    pairs = met.select("rep", "n", "label", F.explode(both).alias("hub")).filter(F.col("label") != F.col("hub.lb"))
    return pairs.select(F.col("rep").alias("a"), "n", F.col("hub.b").alias("b"), F.col("hub.m").alias("m"))


def _open_pairs(keys: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components, among classes in mixed groups, that can still be similar.

    Exact: let both sets be ordered alike, here by frequency, and n <= m be their sizes. They need k = p / (100 + p)
    of n + m shingles in common, so the first n - ceil(k * 2 * n) + 1 of the smaller and m - ceil(p * m / 100) + 1 of
    the larger have one in common; and at the first they share, at places i and j, min(n - i, m - j) are left at most.
    """
    wanted = _in_mixed(keys, labels).select("rep", "label").distinct()
    own = durable(sets.join(wanted, "rep").select("rep", "label", "n", F.explode("set").alias("s")))
    often = own.groupBy("s").agg(F.count("*").alias("often")).filter(F.col("often") > 1)
    ordered = own.join(often, "s", "left").groupBy("rep", "label", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "s"))).alias("o"))
    as_smaller = F.col("n") - F.ceil(F.col("n") * 2 * PERCENT / (100 + PERCENT)) + 1
    as_larger = (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int")
    first = ordered.select("rep", "label", "n", as_smaller.alias("short"), F.posexplode(F.slice("o", F.lit(1), as_larger)).alias("i", "o"))
    first = durable(first.filter(F.col("o.often") > 1).select("rep", "label", "n", "i", (F.col("i") < F.col("short")).alias("short"), "o.s"))
    span = first.groupBy("s").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter(F.col("_low") < F.col("_high"))
    first = durable(first.join(span.select("s"), "s"))
    other = first.select("s", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n").alias("m"), F.col("i").alias("j"))
    enough = (100 + PERCENT) * F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= PERCENT * (F.col("n") + F.col("m"))
    similar_size = (F.col("n") <= F.col("m")) & (100 * F.col("n") >= PERCENT * F.col("m"))
    pairs = first.filter("short").join(other, (first["s"] == other["s"]) & (F.col("label") != F.col("lb")) & similar_size & enough)
    return pairs.select(F.col("rep").alias("a"), "n", "b", "m")
