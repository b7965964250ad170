"""Language of web pages by fusing what the text, the markup, the address and the host say.

Text likelihoods come from a multinomial model over the letters' sequences of up to ``ORDER`` characters, trained on a
sample of at most ``SAMPLE`` labelled documents per language, drawn by hash and counted whole; it keeps the ``GRAMS``
sequences whose share within some language is highest. Everything else is counted over all pages:

* how often each declared language goes with each language of the text (a confusion table, smoothed);
* how often each language part of the address does (the first part of the path, as in ``/fr/``);
* each host's languages, shrunk towards those of its domain, these towards those of its address suffix (the last label),
  these towards those of all pages.

Counts weigh pages by what the text alone says (its posterior), summed by grouped aggregation; a page's own
weight is taken off its host's counts before they judge it. The posterior is the normalised product.

Defined results: a null or empty page, or one without letters, is judged by the other evidence; a null url has the
empty host and suffix; no evidence at all gives the prior of all pages; rows that repeat are judged alike and count once in
the sample, labelled rows may share an id or have none; an empty
table gives no rows; a sample without labels is an error that says so; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.line_dedup import sent
from attestra.llm.main_text import main_text
from attestra.llm.url_filter import host_and_path
from attestra.session import durable

SAMPLE = 1000  # labelled documents per language
ORDER = 3
GRAMS = 30_000  # sequences the model keeps: those with the highest share within a language
TRUST = 0.05  # weight of a sequence's likelihood: neighbouring sequences are not independent
STRENGTH = 5.0  # pseudo-pages behind each level of the host prior
SMOOTH = 1.0
KNOWN_WORDS = 200_000  # a worker keeps
DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})"
LETTERS = re.compile(r"[\W\d_]+")


def words(text: str | None) -> Counter:
    found = Counter(LETTERS.split(text.lower())) if text else Counter()
    found.pop("", None)
    return found


def grams(word: str) -> list[str]:
    """Sequences of 1 to ORDER characters of a word with a blank on either side."""
    padded = f" {word} "
    return [padded[i : i + k] for k in range(1, ORDER + 1) for i in range(len(padded) - k + 1)]


class TextModel:
    """Log-likelihoods of sequences by language. Bounded: ``GRAMS`` rows, one column per language."""

    def __init__(self, languages: list[str], counts: dict[str, list[float]]):
        self.languages = languages
        self.index = {g: i for i, g in enumerate(sorted(counts))}
        table = np.array([counts[g] for g in sorted(counts)]) + 0.5
        self.logs = np.log(table / table.sum(axis=0))
        self.known: dict[str, list[float]] = {}

    def word(self, word: str) -> list[float]:
        """Log-likelihoods of one word; frequent ones are kept, up to a bound."""
        got = self.known.get(word)
        if got is None:
            at = [i for i in map(self.index.get, grams(word)) if i is not None]
            got = self.logs[at].sum(axis=0).tolist()
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = got
        return got

    def likelihoods(self, text: str | None) -> list[float]:
        """Log-likelihood of each language, relative to the best. The text is read whole."""
        found = words(text)
        if not found:
            return [0.0] * len(self.languages)
        total = TRUST * (np.fromiter(found.values(), float, len(found)) @ np.array([self.word(w) for w in found]))
        return (total - total.max()).tolist()


def train(labelled: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> TextModel:
    """From ``labelled`` (text, language). Counting runs on the tasks; the counted model is collected: GRAMS rows."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id, text, F.lit(11)).alias("h"))
    # Hashes are drawn in two steps, so that what is ranked in one place does not grow with the corpus; rows that repeat count once.
    drawn = durable(rows.select("lang", "h").distinct())
    many = durable(drawn.groupBy("lang").agg(F.count("*").alias("many")))
    drawn = drawn.join(many, "lang").filter(F.pmod("h", F.lit(1_000_000)) * F.col("many") < 4 * sample * 1_000_000)
    first = Window.partitionBy("lang").orderBy("h")
    drawn = durable(drawn.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= sample).select("lang", "h"))
    rows = rows.join(sent(drawn, drawn.count()), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang_, texts in b.groupby("lang")["text"]:
                c: Counter = Counter()
                for word, n in words(" ".join(texts)).items():
                    for g in grams(word):
                        c[g] += n
                yield pd.DataFrame({"lang": lang_, "gram": list(c), "n": list(c.values())})

    counted = rows.mapInPandas(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counted = durable(counted)
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not languages:
        raise ValueError("language identification needs labelled documents")
    sums = counted.groupBy("lang").agg(F.sum("n").alias("all"))
    often = counted.join(sums, "lang").groupBy("gram").agg(F.max(F.col("n") / F.col("all")).alias("share")).orderBy(F.desc("share"), "gram").limit(GRAMS)
    table: dict[str, list[float]] = {}
    for r in counted.join(often, "gram").select("gram", "lang", "n").collect():
        table.setdefault(r["gram"], [0.0] * len(languages))[languages.index(r["lang"])] = float(r["n"])
    return TextModel(languages, table)


def _posterior(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def _sums(languages: list[str], weights: str = "w") -> list[Column]:
    return [F.sum(F.col(weights)[i]).alias(f"n{i}") for i in range(len(languages))]


def _rates(languages: list[str], parents: list[Column], strength: float, prefix: str = "n") -> list[Column]:
    """Shares of the languages, shrunk to the parents' shares."""
    total = sum((F.col(f"{prefix}{i}") for i in range(len(languages))), F.lit(0.0))
    return [(F.col(f"{prefix}{i}") + strength * parents[i]) / (total + strength) for i in range(len(languages))]


def evidence(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, host, domain, suffix, section, declared, logs`` of every page: narrow, so that it can be written."""

    def likelihoods(texts: pd.Series) -> pd.Series:
        return pd.Series([model.likelihoods(main_text(t)) for t in texts])

    host, path = host_and_path(F.col(url))
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), DECLARED, 1))
    logs = F.pandas_udf(likelihoods, T.ArrayType(T.DoubleType()))(html)
    section = F.lower(F.regexp_extract(path, "^/([A-Za-z]{2})(?:/|$)", 1))
    return pages.select(F.col(page_id).alias("page_id"), host.alias("host"), domain.alias("domain"), F.element_at(labels, -1).alias("suffix"), section.alias("section"), declared.alias("declared"), logs.alias("logs"))


def identify(pages: DataFrame, model: TextModel, **names: str) -> DataFrame:
    """``page_id, host, lang, probability, text_lang, declared`` for every page."""
    langs, k = model.languages, len(model.languages)
    seen = durable(evidence(pages, model, **names).withColumn("w", _posterior(F.col("logs"))))
    weight = [F.col("w")[i] for i in range(k)]
    every = seen.agg(*_sums(langs)).first()
    total = sum(every[f"n{i}"] or 0.0 for i in range(k))
    overall = [((every[f"n{i}"] or 0.0) + 1.0) / (total + k) for i in range(k)]
    rows = seen
    # Declared language and section given the language: tables as long as there are such values.
    for name in ("declared", "section"):
        table = durable(seen.filter(F.col(name) != "").groupBy(name).agg(*_sums(langs)))
        values = table.count()
        sums = [(every[f"n{i}"] or 0.0) + SMOOTH * (values + 1) for i in range(k)]
        given = F.array(*(F.log((F.col(f"n{i}") + SMOOTH) / F.lit(sums[i])) for i in range(k)))
        rows = rows.join(table.select(name, given.alias(f"log_{name}")), name, "left")
    suffixes = durable(seen.groupBy("suffix").agg(*_sums(langs)))
    suffixes = suffixes.select("suffix", F.array(*_rates(langs, [F.lit(x) for x in overall], STRENGTH)).alias("p"))
    domains = durable(seen.groupBy("domain", "suffix").agg(*_sums(langs)))
    domains = domains.join(suffixes, "suffix").select("domain", F.array(*_rates(langs, [F.col("p")[i] for i in range(k)], STRENGTH)).alias("p"))
    hosts = durable(seen.groupBy("host", "domain").agg(*_sums(langs)))
    hosts = hosts.join(domains, "domain").select("host", "p", *(f"n{i}" for i in range(k)))
    rows = rows.join(hosts, "host", "left")
    for i in range(k):  # the page itself is no evidence about its host
        rows = rows.withColumn(f"n{i}", F.greatest(F.col(f"n{i}") - weight[i], F.lit(0.0)))
    prior = _rates(langs, [F.col("p")[i] for i in range(k)], STRENGTH)
    zero = F.array(*(F.lit(0.0) for _ in range(k)))
    logs = [F.col("logs")[i] + F.log(prior[i]) + F.coalesce("log_declared", zero)[i] + F.coalesce("log_section", zero)[i] for i in range(k)]
    fused = rows.withColumn("post", _posterior(F.array(*logs)))
    names_ = F.array(*(F.lit(x) for x in langs))
    best = lambda c: F.get(names_, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return fused.select("page_id", "host", best(F.col("post")).alias("lang"), F.round(F.array_max("post"), 6).alias("probability"), best(F.col("w")).alias("text_lang"), "declared")
