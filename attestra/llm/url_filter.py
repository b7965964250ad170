"""URL lists of any size: a blocked Bloom filter in front of an exact join. DataFrame functions only.

Listed entries are canonical URLs, a host and the beginning of a path (``example.com/de/``); an entry fits its host
and all subdomains. A page's keys are its host's suffixes with the beginnings of its path, as long as entries are.
The filter is a table of 256-bit blocks built by one aggregation; a key reads one block, and what passes meets the
entries themselves in a hash join, which removes the false positives. Both tables are written, so Spark knows their
size and sends them to every task only below its threshold; longer lists are joined by shuffling the keys.

Defined results: a null url, or one without ``://``, has an empty host and path, which no entry fits; rows that repeat
are judged each for itself; among fitting rules the longest wins, then the last by name; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
WORDS = 4  # of 64 bits in a block; each key sets two bits in each

# Production list: rules in the order of their statement, and hosts that are blocked where no rule fits.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCKED = tuple(f"{name}.example.{end}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def production_list(spark: SparkSession) -> DataFrame:
    """``entry, verdict, is_rule``."""
    rows = [(e, v, True) for e, v in RULES] + [(e, "block", False) for e in BLOCKED]
    return spark.createDataFrame(rows, "entry string, verdict string, is_rule boolean")


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block and its two bits in each of the block's words."""
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    bit = [F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(2 * WORDS)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long"), [bit[2 * w].bitwiseOR(bit[2 * w + 1]) for w in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 ... w3`` of the blocks that hold a key."""
    block, words = _place(F.col("entry"), blocks)
    rows = listed.select(block.alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words)))
    return rows.groupBy("block").agg(*(F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(WORDS)))


def judged(pages: DataFrame, listed: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per page: ``keep``, ``host, path, rule, verdict``; a page that nothing fits is allowed."""
    listed = durable(listed.filter(F.col("entry").isNotNull()).dropDuplicates(["entry"]))
    size = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("entry") - F.instr("entry", "/") + 1).alias("lengths")).first()
    blocks = max(1, -(-size["n"] * BITS_PER_KEY // (64 * WORDS)))
    blooms = durable(bloom(listed, blocks))
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # Lengths of the entries' paths: as many as a URL is long, at most.
    lengths = F.array(*(F.lit(n) for n in sorted(size["lengths"]))) if size["lengths"] else F.array().cast("array<int>")
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    # Every page also sends one row without a key, so that it comes back when nothing fits.
    probes = rows.select("*", F.explode(F.concat(F.array(F.lit(None).cast("string")), keys)).alias("key"))
    block, words = _place(F.col("key"), blocks)
    probes = probes.withColumn("block", F.when(F.col("key").isNotNull(), block)).join(blooms, "block", "left")
    passes = F.lit(True)
    for i, w in enumerate(words):
        passes = passes & (F.col(f"w{i}").bitwiseAND(w) == w)
    names = [c for c in rows.columns]
    probes = probes.filter(F.col("key").isNull() | F.coalesce(passes, F.lit(False))).select(*names, "key")
    exact = listed.withColumnRenamed("entry", "key")
    hits = probes.join(exact, "key", "left").filter(F.col("key").isNull() | F.col("verdict").isNotNull())
    best = F.max(F.when(F.col("is_rule"), F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), "verdict"))).alias("best")
    other = F.max(F.when(~F.col("is_rule"), F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), "verdict"))).alias("other")
    out = hits.groupBy(*names).agg(best, other)
    return out.select(
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", "other.verdict", F.lit("allow")).alias("verdict"),
    )
