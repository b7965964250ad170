"""Routing of requests, per-session budgets, latest values, usage cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import strip

# --- fixed values: ordered routing rules, session limits, prices (USD per million tokens: input, output)
ROUTES = [
    ("deck", r"\b(deck|slides?|powerpoint|pptx|presentation)\b"),
    ("report", r"\b(report|memo|write[- ]?up|word doc|docx|summary document)\b"),
    ("decide", r"\b(decide|decision|should we|go/no-go|trade-?off|recommend)\b"),
    ("brainstorm", r"\b(brainstorm|ideas?|ideate|concepts?)\b"),
    ("analyze", r"\b(average|mean|median|sum|total|count|percent|compare|trend|chart|statistic|excel|xlsx|sheet|table)\b"),
    ("capture", r"\b(https?://|website|crawl|scrape|web ?page|online source)\b"),
    ("ask", r"\b(what|which|who|when|where|why|how|find|summari[sz]e|according)\b"),
]
SKIP_STARTS = ["/", "!", "#", "<"]
MIN_REQUEST = 12
TIPS_PER_SESSION = 3
PRICES = [("opus", 4.0, 20.0), ("sonnet", 2.0, 10.0), ("haiku", 1.0, 5.0)]
CACHE_READ, CACHE_WRITE = 0.1, 2.0
# ---------------------------------------------------------------------------------------------------------


def route(c: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Name of the first rule a request matches; null for commands, notes and very short ones."""
    text = strip(c)
    skip = F.length(text) < MIN_REQUEST
    for s in SKIP_STARTS:
        skip = skip | text.startswith(s)
    hit = F.when(skip, None)
    for name, rx in rules or ROUTES:
        hit = hit.when(text.rlike("(?iU)" + rx), name)
    return hit.otherwise(None)


def budget(df: DataFrame, by: list[str], order: list[str], n: int = TIPS_PER_SESSION) -> DataFrame:
    """The first ``n`` rows of each session. Spark keeps n per task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def once(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return budget(df, by, order, 1)


def latest(df: DataFrame, by: list[str], order: str, value: str, name: str = "latest") -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(value, order).alias(name))


def usage_cost(messages: DataFrame) -> DataFrame:
    """(agent, model, usd, share): each message id counts once, synthetic models not at all.

    ``messages`` holds agent, model, message_id, input_tokens, output_tokens, cache_read, cache_write.
    """
    real = messages.filter(~F.col("model").startswith("<"))
    once_each = real.groupBy("message_id").agg(
        F.min(F.struct("agent", "model", "input_tokens", "output_tokens", "cache_read", "cache_write")).alias("m")
    ).select("m.*")
    price = lambda i: F.coalesce(*[F.when(F.col("model").contains(p[0]), p[i]) for p in PRICES], F.lit(0.0))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    fed = n("input_tokens") + n("cache_read") * CACHE_READ + n("cache_write") * CACHE_WRITE
    usd = (fed * price(1) + n("output_tokens") * price(2)) / 1e6
    totals = once_each.groupBy("agent", "model").agg(F.sum(usd).alias("usd"))
    whole = totals.agg(F.sum("usd").alias("all")).select("all").scalar()
    return totals.withColumn("share", F.coalesce(F.try_divide(F.col("usd"), whole), F.lit(0.0)))
