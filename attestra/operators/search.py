"""Ranked search: query parsing, BM25 over fields, phrases, fusion, diversification, pinned blocks, snippets.

Queries are rows (search_id, query_no, query); one search may hold several phrasings and many searches
run in one job. Chunks are rows (chunk_id, doc_id, title, section, text). Token postings are produced by
a narrow explode and cut down to the words meant before anything is shuffled. Joins with the query side
carry no broadcast hint: Spark broadcasts it while it is small and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.stem import stem
from attestra.functions.text import collapse, fold, glob_to_regex, lead_text
from attestra.operators.vectors import nearest_each
from attestra.scale import pinned
from attestra.session import durable

# --- fixed values ---------------------------------------------------------------------------------
RRF_K = 60
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 2.0, "section": 3.0, "text": 1.0}
PENALTY = 0.35
MIN_IDF = 1e-6
STOP_WORDS = (
    "a an and are as at be by for from has have how in is it its of on or that the this to was were what when where "
    "which who why with does did do can could should would we our you your i me my about into than then there"
).split()
WORD = r"(?U)\w[\w'.-]*"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
# --------------------------------------------------------------------------------------------------


def tokens(c: Column) -> Column:
    """Folded letter-and-digit runs in order."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_words(query: Column) -> Column:
    """Words of a query outside quotes, without stop words and stray punctuation."""
    rest = F.regexp_replace(query, r'"[^"]+"', " ")
    words = F.transform(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)), lambda w: F.btrim(w, F.lit(".'-")))
    return F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(STOP_WORDS))


def parse_queries(queries: DataFrame) -> DataFrame:
    """search_id, query_no, term_no, term, tokens, n_terms: quoted phrases first, then single words."""
    phrases = F.regexp_extract_all("query", F.lit(r'"([^"]+)"'), F.lit(1))
    terms = F.concat(phrases, query_words(F.col("query")))
    rows = queries.select("search_id", "query_no", F.size(terms).alias("n_terms"), F.posexplode(terms).alias("term_no", "term"))
    return rows.withColumn("tokens", tokens(F.col("term"))).filter(F.size("tokens") > 0)


def postings(chunks: DataFrame, id: str = "chunk_id") -> DataFrame:
    """One row per token occurrence: chunk_id, n_tokens (of the whole chunk), token, field, pos. No shuffle.

    Rows that meet the words of a search in a join never leave the task that made them; sorting the words of a chunk
    into one row per word first takes more than twice as long.
    """
    tagged = F.concat(*[F.transform(tokens(F.col(f)), _tagged(f)) for f in _fields(chunks)])
    rows = chunks.select(F.col(id).alias("chunk_id"), F.explode(F.array(tagged)).alias("_words"))
    rows = rows.select("chunk_id", F.size("_words").alias("n_tokens"), F.explode("_words").alias("p"))
    return rows.select("chunk_id", "n_tokens", "p.token", "p.field", "p.pos")


def _fields(chunks: DataFrame) -> list[str]:
    return [f for f in FIELD_WEIGHTS if f in chunks.columns]


def _tagged(field: str):
    return lambda t, i: F.struct(t.alias("token"), F.lit(field).alias("field"), i.alias("pos"))


def stem_vocab(tokens_df: DataFrame) -> DataFrame:
    """(token, stem) of distinct tokens: stemming costs once per word of the vocabulary."""
    return tokens_df.select("token").distinct().withColumn("stem", stem(F.col("token")))


def query_tokens(terms: DataFrame) -> DataFrame:
    return terms.select(
        "search_id", "query_no", "term_no", "n_terms", F.size("tokens").alias("n_tok"), F.posexplode("tokens").alias("j", "token")
    )


def corpus_words(chunks: DataFrame, qtokens: DataFrame, stemmed: bool, id: str = "chunk_id") -> DataFrame:
    """token, n_chunks, n_tokens: words of the corpus a search may mean, and under a NULL token all chunks and their length.

    One pass gives both. Without stemming these are the very tokens; else those that start like one: a word starts
    with its stem without the stem's last letter, so stems of three letters and more share the first two letters with
    their words, shorter ones the first. Each task reduces its rows to words before anything is shuffled.
    """
    parts = chunks.select(F.explode(F.array(F.concat(*[tokens(F.col(f)) for f in _fields(chunks)]))).alias("_words"))
    whole_chunk = F.array(F.lit(None).cast("string"))
    rows = parts.select(F.size("_words").alias("n"), F.explode(F.concat(whole_chunk, "_words")).alias("token"))
    asked = qtokens.select("token").distinct()
    start = F.col("token")
    if stemmed:
        asked = asked.withColumn("stem", stem(F.col("token")))
        brief = asked.filter(F.length("stem") < 3).agg(F.collect_set(F.substring("stem", 1, 1)).alias("letters"))  # single letters
        letter = F.substring("token", 1, 1)
        start = F.when(F.array_contains(brief.select("letters").scalar(), letter), letter).otherwise(F.substring("token", 1, 2))
    whole = chunks.sparkSession.range(1).select(F.lit("").alias("start"))  # stands for the row of all chunks
    starts = durable(asked.select(start.alias("start")).distinct().unionByName(whole))
    near = rows.withColumn("start", F.when(F.col("token").isNull(), "").otherwise(start)).join(starts, "start", "left_semi")
    all_chunks = F.col("token").isNull()
    return durable(near.groupBy("token").agg(F.count_if(all_chunks).alias("n_chunks"), F.sum(F.when(all_chunks, F.col("n"))).alias("n_tokens")))


def expand_stems(qtokens: DataFrame, words: DataFrame) -> DataFrame:
    """Replace each query token by every corpus word with the same stem; each word is stemmed once."""
    wanted = qtokens.withColumn("stem", stem(F.col("token"))).drop("token")
    return wanted.join(stem_vocab(words.filter("token is not null")), "stem").drop("stem")


def term_matches(posted: DataFrame, qtokens: DataFrame) -> DataFrame:
    """search_id, query_no, term_no, chunk_id, n_terms, n_tokens, tf (weighted by field).

    Each occurrence of the j-th token of a term votes for the place the term would start at; a place
    with all votes is an occurrence of the term, so words and phrases are one aggregation.
    """
    key = ["search_id", "query_no", "term_no", "n_terms", "chunk_id", "n_tokens"]
    hits = posted.join(qtokens, "token")
    at = hits.groupBy(*key, "field", (F.col("pos") - F.col("j")).alias("start"), "n_tok").agg(F.count("*").alias("votes"))
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in FIELD_WEIGHTS.items()])
    return at.filter("votes = n_tok").groupBy(*key).agg(F.sum(weight).alias("tf"))


def bm25(chunks: DataFrame, queries: DataFrame, stemmed: bool = True, id: str = "chunk_id") -> DataFrame:
    """search_id, query_no, chunk_id, score, n_hit, n_terms: every chunk with at least one term.

    Term rarity counts all chunks, whatever is filtered afterwards. The corpus is read twice: for the words it has
    near those asked for, a small table, and for the places of exactly the words meant.
    """
    qtokens = query_tokens(parse_queries(queries))
    words = corpus_words(chunks, qtokens, stemmed, id)
    meant = durable(expand_stems(qtokens, words) if stemmed else qtokens)
    matches = durable(term_matches(postings(chunks, id), meant))
    stats = words.filter("token is null").select("n_chunks", (F.col("n_tokens") / F.col("n_chunks")).alias("avg_tokens"))
    term = ["search_id", "query_no", "term_no"]
    df = matches.groupBy(*term).agg(F.count("*").alias("df"))
    n = stats.select("n_chunks").scalar()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = df.select(*term, F.when(idf > 0, idf).otherwise(MIN_IDF).alias("idf"))
    length = 1 - B + B * F.col("n_tokens") / stats.select("avg_tokens").scalar()
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    return matches.join(df, term).groupBy("search_id", "query_no", "n_terms", "chunk_id").agg(
        F.round(F.sum(score), 9).alias("score"), F.count("*").alias("n_hit")  # equal sums tie, whatever their order
    )


def top_ranked(scored: DataFrame, by: list[str], pool: int, id: str = "chunk_id") -> DataFrame:
    """The ``pool`` best per key with ``rank``; ties go to the smaller id. Cut before the shuffle by Spark."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(id))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= pool)


def passes(scored: DataFrame, pool: int) -> DataFrame:
    """Rankings of each query: all chunks with any term and, for several terms, those with every term."""
    any_term = top_ranked(scored, ["search_id", "query_no"], pool).withColumn("pass", F.lit("any"))
    every = scored.filter("n_terms >= 2 and n_hit = n_terms")
    return any_term.unionByName(top_ranked(every, ["search_id", "query_no"], pool).withColumn("pass", F.lit("all")))


def rrf(ranked: DataFrame, by: list[str], label: str, k: int = RRF_K) -> DataFrame:
    """Fuse rankings: sum of 1 / (k + rank) per item; ``matched`` lists the labels that found it, in order."""
    return ranked.groupBy(*by).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.array_sort(F.collect_set(label)).alias("matched")
    )


def diversify(hits: DataFrame, k: int, by: list[str], doc: str = "doc_id", id: str = "chunk_id", penalty: float = PENALTY) -> DataFrame:
    """The k best per search when every further hit of one document counts less.

    Picking greedily is the same as ordering by the damped score: within a document damped scores only
    fall, so the greedy pick merges sorted lists. No more than k hits of a document can be picked.
    """
    per_doc = Window.partitionBy(*by, doc).orderBy(F.col("score").desc(), F.col(id))
    first = hits.withColumn("nth", F.row_number().over(per_doc)).filter(F.col("nth") <= k)
    damped = first.withColumn("damped", F.col("score") / (1 + penalty * (F.col("nth") - 1)))
    best = Window.partitionBy(*by).orderBy(F.col("damped").desc(), F.col("score").desc(), F.col(id))
    return damped.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("nth", "damped")


def snippets(hits: DataFrame, text: str, words: Column, width: int = 28, name: str = "snippet") -> DataFrame:
    """Add a window of ``width`` words with most query words, matches marked, cuts shown."""
    zero = F.lit(0)
    parts = F.transform(F.split(collapse(F.col(text)), " "), lambda p: F.struct(p.alias("p"), _is_hit(p, words).alias("f")))
    df = pinned(hits, "_parts", parts)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_parts") - width + 1, F.lit(1)))
    window = lambda s: F.slice("_parts", s, F.lit(width))
    counts = F.transform(starts, lambda s: F.aggregate(window(s), zero, lambda a, x: a + x["f"]))
    df = pinned(df, "_counts", counts)
    df = df.withColumn("_best", F.array_position("_counts", F.array_max("_counts")).cast("int"))
    best = F.col("_best")
    shown = F.transform(
        window(best), lambda z: F.when(z["f"] == 1, F.concat(F.lit("«"), z["p"], F.lit("»"))).otherwise(z["p"])
    )
    head = F.when(best > 1, "… ").otherwise("")
    tail = F.when(best + width - 1 < F.size("_parts"), " …").otherwise("")
    return df.withColumn(name, F.concat(head, F.array_join(shown, " "), tail)).drop("_parts", "_counts", "_best")


def _is_hit(word: Column, words: Column) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(fold(word), F.lit(TOKEN), F.lit(0)), words).cast("int")


def query_stems(queries: DataFrame) -> DataFrame:
    """search_id, stems: first five letters of the words a search asks for."""
    words = F.regexp_extract_all("query", F.lit(WORD), F.lit(0))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(STOP_WORDS) & (F.length(w) > 1))
    five = F.transform(kept, lambda w: F.substring(F.lower(w), 1, 5))
    return queries.groupBy("search_id").agg(F.array_distinct(F.flatten(F.collect_list(five))).alias("stems"))


def pin_blocks(hits: DataFrame, blocks: DataFrame, queries: DataFrame, shown: int = 3) -> DataFrame:
    """Per hit the first blocks of its chunk that hold most query stems; single-block hits are left alone.

    ``hits`` needs search_id, chunk_id, doc_id, first_seq, last_seq. A chunk is bounded in size, so its
    sequence numbers are spelled out and met by an equi-join.
    """
    span = hits.filter("last_seq > first_seq").select(
        "search_id", "chunk_id", "doc_id", F.explode(F.sequence("first_seq", "last_seq")).alias("seq")
    )
    inside = span.join(blocks.select("doc_id", F.col("seq").cast("long").alias("seq"), "anchor", "text"), ["doc_id", "seq"])
    inside = inside.join(query_stems(queries), "search_id")
    n = F.size(F.filter("stems", lambda s: F.contains(F.lower("text"), s)))
    scored = inside.select("search_id", "chunk_id", "seq", "anchor", n.alias("n")).filter("n > 0")
    w = Window.partitionBy("search_id", "chunk_id").orderBy(F.col("n").desc(), "seq")
    top = scored.withColumn("rn", F.row_number().over(w)).withColumn("most", F.first("n").over(w))
    return top.filter((F.col("n") == F.col("most")) & (F.col("rn") <= shown)).select("search_id", "chunk_id", "seq", "anchor", "n")


def exact_search(blocks: DataFrame, pattern: str, regex: bool = False, k: int = 30, context: int = 70) -> tuple[DataFrame, DataFrame]:
    """(total, first k lines): blocks that contain the pattern in any case, each with its surroundings.

    The count is an aggregate and the list a limited sort, so neither gathers all matches.
    """
    rx = "(?iu)" + (pattern if regex else "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    found = blocks.filter(F.col("text").rlike(rx))
    total = found.agg(F.count("*").alias("n_blocks"))
    before = F.get(F.split("text", rx, 2), F.lit(0))
    match = F.regexp_extract("text", rx, 0)
    lo = F.greatest(F.length(before) - context, F.lit(0))
    hi = F.length(before) + F.length(match) + context
    line = collapse(F.substring(F.col("text"), lo + 1, hi - lo))
    lines = found.orderBy("doc_id", "seq").limit(k)
    return total, lines.select("doc_id", "seq", "anchor", F.concat(F.lit("…"), line, F.lit("…")).alias("context"))


def filter_docs(docs: DataFrame, types: list[str] | None = None, path_glob: str | None = None) -> DataFrame:
    out = docs
    if types:
        out = out.filter(F.col("doc_type").isin(types))
    return out.filter(F.col("path").rlike(glob_to_regex(path_glob))) if path_glob else out


def search(
    chunks: DataFrame, queries: DataFrame, k: int = 8, allowed: DataFrame | None = None, semantic: DataFrame | None = None, stemmed: bool = True
) -> DataFrame:
    """search_id, place, chunk_id, doc_id, score (x1000), matched: fused, diversified hits.

    ``allowed`` (doc_id) narrows results, ``semantic`` (search_id, chunk_id, rank) joins the fusion.
    """
    pool = max(4 * k, 20)
    scored = bm25(chunks, queries, stemmed)
    owner = chunks.select("chunk_id", "doc_id")
    if allowed is not None:
        kept = owner.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
        scored = scored.join(kept.select("chunk_id"), "chunk_id", "left_semi")
    label = F.concat(F.lit("q"), F.lpad(F.col("query_no").cast("string"), 6, "0"))
    ranked = passes(scored, pool).select("search_id", "chunk_id", "rank", label.alias("label"))
    if semantic is not None:
        ranked = ranked.unionByName(semantic.select("search_id", "chunk_id", "rank", F.lit("~semantic").alias("label")))
    fused = rrf(ranked, ["search_id", "chunk_id"], "label").join(owner, "chunk_id")
    best = diversify(fused, k, ["search_id"])
    return best.select(
        "search_id", "place", "chunk_id", "doc_id", F.round(F.col("score") * 1000, 2).alias("score"), "matched"
    )


def search_results(
    chunks: DataFrame,
    blocks: DataFrame,
    docs: DataFrame,
    queries: DataFrame,
    k: int = 8,
    types: list[str] | None = None,
    path_glob: str | None = None,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
) -> DataFrame:
    """What a reader gets of ``search``: search_id, place, chunk_id, ref, path, doc_type, title, section, first_seq, last_seq, snippet, best, score, matched.

    ``chunks`` also need anchor, first_seq, last_seq; ``docs`` doc_id, path, doc_type; ``vectors`` (chunk_id, embedding) and
    ``query_vectors`` (search_id, embedding) add a ranking by meaning under "~semantic". The snippet marks the words of the
    searched stems; a hit that no word found shows its opening. ``best`` lists the anchors inside the chunk that answer the
    search. Everything after the ranking works on k chunks a search.
    """
    allowed = filter_docs(docs, types, path_glob) if types or path_glob else None
    semantic = None
    if vectors is not None and query_vectors is not None:
        if allowed is not None:
            owner = chunks.select("chunk_id", "doc_id").join(allowed.select("doc_id"), "doc_id", "left_semi")
            vectors = vectors.join(owner, "chunk_id", "left_semi")
        semantic = nearest_each(vectors, query_vectors, max(4 * k, 20), "chunk_id").select("search_id", "chunk_id", "rank")
    hits = durable(search(chunks, queries, k, allowed, semantic))
    about = chunks.select("chunk_id", "anchor", "title", "section", "first_seq", "last_seq", "text")
    seen = durable(hits.join(about, "chunk_id"))
    asked = query_tokens(parse_queries(queries))
    shown = seen.select(F.explode(tokens(F.col("text"))).alias("token"))
    words = expand_stems(asked, shown).groupBy("search_id").agg(F.collect_set("token").alias("_words"))
    told = snippets(seen.join(words, "search_id", "left"), "text", F.coalesce("_words", F.array().cast("array<string>")))
    by_meaning = F.col("matched") == F.array(F.lit("~semantic"))
    told = told.withColumn("snippet", F.when(by_meaning, lead_text(F.col("text"))).otherwise(F.col("snippet")))
    pins = pin_blocks(seen, blocks, queries).groupBy("search_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("seq", "anchor"))).alias("_pins"))
    told = told.join(pins, ["search_id", "chunk_id"], "left").join(docs.select("doc_id", "path", "doc_type"), "doc_id", "left")
    return told.select(
        "search_id", "place", "chunk_id", F.concat("doc_id", F.lit("#"), "anchor").alias("ref"), "path", "doc_type", "title", "section",
        "first_seq", "last_seq", "snippet", F.coalesce(F.col("_pins.anchor"), F.array().cast("array<string>")).alias("best"), "score", "matched",
    )
