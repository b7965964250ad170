"""Quality rules with host verdicts.

Every document is measured over its whole text; the failures of each rule are summed by host, each host's
failure rate is shrunk towards the rate of all hosts with an empirical beta prior, and a host whose shrunk
rate of any rule is over the limit takes its documents with it.

Defined results: a null text has no words and fails the length rule; a null host is no host, so only the
document's own rules judge it; rows that repeat are judged each for itself; an empty table gives no rows.
Columns that documents have besides the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.session import durable

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
HOST_LIMIT = 0.5
RULES = ("short", "repeats", "symbols", "lines")


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated three-word windows, lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at the six ASCII spaces only
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            again += line in seen
            seen.add(line)
    return n, chars, sum(map(text.count, SYMBOLS)), again, repeated_words(words), lines


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found at two or more places."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        windows = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    for at in (order[1:][same], order[:-1][same]):
        hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in MEASURES]))
def measure(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measures(t) for t in text], columns=MEASURES)


def rule_failures(m: str) -> dict:
    """Each rule over the struct column ``m`` of :func:`measure`. The first two are the base rules."""
    n, c = F.col(f"{m}.n_words"), lambda name: F.col(f"{m}.{name}")
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * c("n_repeat_words") > 50 * n,
        "symbols": 10 * c("n_symbols") > 3 * n,
        "lines": 2 * c("n_dup_lines") > c("n_lines"),
    }


def bad_hosts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``host``, number of documents and shrunk failure rates of the hosts over the limit.

    ``measured``: ``_host`` and the struct ``_m``. Counts are summed on each task before the shuffle, so a host
    with a third of all rows is one row from each task. The prior of a rule is the beta distribution with the
    mean and the variance of the hosts' rates, less the variance that sampling explains.
    """
    fails = rule_failures("_m")
    hosts = measured.filter(F.col("_host").isNotNull()).groupBy("_host").agg(
        F.count("*").alias("n"), *(F.sum(fails[r].cast("long")).alias(r) for r in RULES)
    )
    hosts = durable(hosts)
    sums = [F.sum("n").alias("n"), F.count("*").alias("hosts")]
    sums += [F.sum(r).alias(r) for r in RULES] + [F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"sq_{r}") for r in RULES]
    total = hosts.agg(*sums).first()
    over = F.lit(False)
    for r in RULES:
        mean, strength = prior(total["n"] or 0, total["hosts"], total[r] or 0, total[f"sq_{r}"] or 0.0)
        rate = (F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        hosts = hosts.withColumn(f"rate_{r}", rate)
        over = over | (F.col(f"rate_{r}") > limit)
    return hosts.filter(over)


def prior(n: int, hosts: int, fails: int, squares: float) -> tuple[float, float]:
    """Mean and strength (pseudo-documents) of the beta prior; ``squares`` is the sum of fails² / n over hosts."""
    if not n:
        return 0.0, 1.0
    mean = fails / n
    spread = mean * (1 - mean)
    between = squares / n - mean * mean - spread * hosts / n
    if spread == 0 or between <= 0:
        return mean, 1e6
    return mean, min(max(spread / between - 1, 1.0), 1e6)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """All rows of ``docs`` as ``_row`` with ``_m`` (measures), ``base_failed`` and ``kept``.

    The texts are measured twice, once for the hosts and once for the rows: that is cheaper than a copy of them.
    """
    measured = durable(docs.select(F.col(host).cast("string").alias("_host"), measure(text).alias("_m")))
    bad = bad_hosts(measured, limit).select(F.col("_host").alias("_bad"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.col(host).cast("string").alias("_host"), measure(text).alias("_m"))
    fails = rule_failures("_m")
    base = fails["short"] | fails["repeats"]
    judged = rows.join(bad, F.col("_host") == F.col("_bad"), "left")
    return judged.select("_row", "_m", base.alias("base_failed"), (~base & F.col("_bad").isNull()).alias("kept"))


def quality_report(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: its counts, whether it fails the base rules, and whether it stays.

    Here the texts are not needed again, so the measures are written once and serve hosts and rows.
    """
    measured = durable(docs.select("doc_id", F.col("source").cast("string").alias("_host"), measure("text").alias("_m")))
    bad = bad_hosts(measured, limit).select(F.col("_host").alias("_bad"))
    fails = rule_failures("_m")
    base = fails["short"] | fails["repeats"]
    judged = measured.join(bad, F.col("_host") == F.col("_bad"), "left")
    counts = [F.col(f"_m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, base.alias("base_failed"), (~base & F.col("_bad").isNull()).alias("kept"))
