"""Benchmark passages in training text by a distributed positional index. DataFrame functions only.

Words are runs of digits, letters a-z and anything beyond ASCII, after lower-casing A-Z. A window is ``SPAN`` consecutive
words of a benchmark item; a shorter item is one window as a whole.

1. The frequency of every benchmark word in the whole corpus is counted (summed on each task before the shuffle).
2. For each distinct window its two rarest words are its test terms; windows with a word the corpus lacks cannot occur.
3. The index holds the postings (document, position) of the test terms and is written once as a table.
4. The postings of the rarest term, moved by the distance to the second, are intersected with that one's postings;
   what remains names a window and a start, and the document's own words decide: word by word for phrases, or, for
   proximity, all words of the window within ``slop`` words around the place.

Test terms are benchmark words, so the index grows with the corpus and the vocabulary is bounded by the benchmark;
Spark sends the vocabulary to every task only while the written table is below its threshold.

Defined results: null or empty texts have no words and no hits; an item without words has no window; an item with a null
id still marks words, but is not listed; rows that share an id are judged each by its own text; an empty benchmark or
empty documents give no hits; columns besides the named ones are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.line_dedup import sent
from attestra.llm.url_filter import LOWER, UPPER
from attestra.scale import pinned
from attestra.session import durable

SPAN = 13
SHARE = 20  # a document is contaminated when one word in so many is hit
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_ID = -(2**63)


def word_list(text: str) -> Column:
    """Words of a text, first and last included; ASCII texts take the short way to lower case."""
    t = F.coalesce(F.col(text), F.lit(""))
    lower = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.filter(F.split(lower, BREAK), lambda w: w != "")


def _windows(benchmark: DataFrame, item_id: str, text: str, span: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows as ``win`` (words joined by spaces) and ``words``; and ``win, item``."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), word_list(text).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(span))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    each = items.select("item", "w", size.alias("n"), starts.alias("s")).select("item", F.slice("w", F.col("s"), F.col("n")).alias("words"))
    each = each.withColumn("win", F.array_join("words", " "))
    owners = durable(each.select("win", "item").distinct())
    return durable(each.select("win", "words").dropDuplicates(["win"])), owners


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_id, _t`` stand for a document in joins: its id (or a stand-in for null) and a digest of its text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_t"), F.col(text).alias("_text"))


def _test_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``win, n, term, at, term2, at2``: the two rarest words of each window that can occur (one word: itself twice)."""
    each = windows.select("win", F.size("words").alias("n"), F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    ranked = each.groupBy("win", "n").agg(
        F.min(F.coalesce("often", F.lit(0))).alias("least"), F.array_sort(F.collect_list(F.struct("often", "at", "term"))).alias("r")
    )
    two = F.least(F.lit(2), F.col("n"))
    ranked = ranked.filter(F.col("least") > 0).withColumn("a", F.element_at("r", 1)).withColumn("b", F.element_at("r", two))
    return ranked.select("win", "n", F.col("a.term").alias("term"), F.col("a.at").alias("at"), F.col("b.term").alias("term2"), F.col("b.at").alias("at2"))


def matches(docs: DataFrame, benchmark: DataFrame, slop: int = 0, span: int = SPAN, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``_id, _t, hits`` (array of start, length, window) of the documents with a match; and ``win, item``."""
    windows, owners = _windows(benchmark, item_id, item_text, span)
    vocabulary = durable(windows.select(F.explode("words").alias("term")).distinct())
    keyed = _keyed(docs, doc_id, text)
    tokens = keyed.select(F.explode(word_list("_text")).alias("term")).join(vocabulary, "term")
    counts = durable(tokens.groupBy("term").agg(F.count("*").alias("often")))
    terms = durable(_test_terms(windows, counts))
    wanted = durable(terms.select("term").union(terms.select("term2")).distinct())
    index = durable(keyed.select("_id", "_t", F.posexplode(word_list("_text")).alias("pos", "term")).join(wanted, "term"))
    pairs = terms.select("term", "term2", (F.col("at2") - F.col("at")).alias("step")).distinct()
    moved = index.join(pairs, "term").select("_id", "_t", "pos", "term", "term2", "step", F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("off"))
    moved = moved.withColumn("pos2", F.col("pos") + F.col("step") + F.col("off"))
    second = index.select("_id", "_t", F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    met = moved.join(second, ["_id", "_t", "term2", "pos2"], "left_semi").select("_id", "_t", "pos", "term", "term2", "step").distinct()
    placed = met.join(terms.withColumn("step", F.col("at2") - F.col("at")), ["term", "term2", "step"])
    places = placed.groupBy("_id", "_t").agg(F.collect_set(F.struct((F.col("pos") - F.col("at")).alias("start"), "n", "win")).alias("places"))
    places = durable(places)
    asked = places.select("_id", "_t")
    texts = keyed.join(sent(asked, asked.count()), ["_id", "_t"], "left_semi")  # only these texts may travel
    found = texts.join(places, ["_id", "_t"]).select("_id", "_t", "places", "_text")
    found = pinned(found, "w", word_list("_text"))  # once per text, not once per place
    if slop:
        first = lambda p: F.greatest(p["start"] - slop, F.lit(0))
        stretch = lambda p: F.slice(F.col("w"), first(p) + 1, p["start"] + p["n"] + slop - first(p))
        true = lambda p: F.size(F.array_except(F.split(p["win"], " "), stretch(p))) == 0
    else:
        true = lambda p: (p["start"] >= 0) & (F.array_join(F.slice(F.col("w"), F.greatest(p["start"], F.lit(0)) + 1, p["n"]), " ") == p["win"])
    hits = found.select("_id", "_t", F.filter("places", true).alias("hits")).filter(F.size("hits") > 0).dropDuplicates(["_id", "_t"])
    return hits, owners


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    keyed = _keyed(docs, doc_id, text)
    words = keyed.select("doc_id", "_id", "_t", F.size(word_list("_text")).cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.sha2(F.lit(""), 256)
    out = words.join(contaminated_words(docs, benchmark, doc_id, text, **names), ["_id", "_t"], "left")
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated")
    )


def contaminated_words(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """``_id, _t, n_hit, n_items, items_sha256`` of the documents with a phrase match."""
    hits, owners = matches(docs, benchmark, doc_id=doc_id, text=text, **names)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    hits = durable(hits.select("_id", "_t", F.size(covered).alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["win"])).alias("wins")))
    items = hits.select("_id", "_t", "n_hit", F.explode("wins").alias("win")).join(owners, "win")
    items = items.groupBy("_id", "_t", "n_hit").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return items.select("_id", "_t", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text`` and others) that are not contaminated, as they are."""
    found = contaminated_words(docs, benchmark).select("_id", "_t", "n_hit")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), "doc_id", "text")
    rows = rows.select("_row", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_t"))
    found = durable(found)
    rows = rows.join(sent(found, found.count()), ["_id", "_t"], "left")
    bad = F.col("n_hit").isNotNull() & (SHARE * F.col("n_hit") >= F.size(word_list("_row.text")))
    return rows.filter(~bad).select("_row.*")
