"""Ranked, exact and vector search over documents, pages and embeddings."""

import math

from pyspark.sql import functions as F

from attestra.operators import chunks as C
from attestra.operators import search as S
from attestra.operators import vectors as V
from attestra.plans.derived import LINES_SQL
from attestra.plans.registry import register
from attestra.session import durable, load
from attestra.sources import blocks as B

# the searches the queries below run: several phrasings each, with phrases, stop words and a part code
SEARCHES = [
    (1, 1, "license version"),
    (1, 2, 'What is the "apache license"?'),
    (2, 1, "MIT license or the token"),
    (2, 2, "public key"),
    (3, 1, '"version 3" que der'),
]
SEARCH_SCHEMA = "search_id int, query_no int, query string"

# the same terms, parsed by hand: (search, query, term, n_terms, j, token, n_tok)
_TERMS = [
    (1, 1, 0, 2, 0, "license", 1), (1, 1, 1, 2, 0, "version", 1),
    (1, 2, 0, 1, 0, "apache", 2), (1, 2, 0, 1, 1, "license", 2),
    (2, 1, 0, 3, 0, "mit", 1), (2, 1, 1, 3, 0, "license", 1), (2, 1, 2, 3, 0, "token", 1),
    (2, 2, 0, 2, 0, "public", 1), (2, 2, 1, 2, 0, "key", 1),
    (3, 1, 0, 3, 0, "version", 2), (3, 1, 0, 3, 1, "3", 2), (3, 1, 1, 3, 0, "que", 1), (3, 1, 2, 3, 0, "der", 1),
]
TOK = "regexp_extract_all(lower(strip_accents({0})), '[\\p{{L}}\\p{{N}}]+')"
DOCS_SQL = "docs as (select doc_id, source as owner, split_part(text, chr(10), 1) as title, source as section, text from documents)"


def bm25_sql(docs: str, families: dict[str, list[str]] | None = None, only: str = "true", semantic: str = "") -> str:
    """CTEs of a search over ``docs`` (doc_id, owner, title, section, text); ``families`` lists further words of a token.

    ``only`` is a condition on the documents that are ranked, ``semantic`` selects (search_id, label, doc_id, rank) of a ranking by meaning.
    """
    words = [(t, w) for t in sorted({x[5] for x in _TERMS}) for w in [t, *(families or {}).get(t, [])]]
    return f"""
  {docs},
  arr as (select doc_id, {TOK.format('title')} as a, {TOK.format('section')} as b, {TOK.format('text')} as c from docs),
  len as (select doc_id, len(a) + len(b) + len(c) as n from arr),
  tok as (select doc_id, 'title' as field, 2.0 as w, unnest(a) as token, generate_subscripts(a, 1) as pos from arr
    union all select doc_id, 'section', 3.0, unnest(b), generate_subscripts(b, 1) from arr
    union all select doc_id, 'text', 1.0, unnest(c), generate_subscripts(c, 1) from arr),
  asked(search_id, query_no, term_no, n_terms, j, word, n_tok) as (values {', '.join(map(str, _TERMS))}),
  fam(word, token) as (values {', '.join(map(str, words))}),
  q as (select * from asked join fam using (word)),
  places as (select search_id, query_no, term_no, n_terms, doc_id, field, w, pos - j as at_pos from tok join q using (token)
    group by all having count(*) = max(n_tok)),
  tf as (select search_id, query_no, term_no, n_terms, doc_id, sum(w) as tf from places group by all),
  df as (select search_id, query_no, term_no, count(*) as df from tf group by all),
  st as (select count(*) as n, avg(n) as av from len),
  scored as (select search_id, query_no, n_terms, doc_id, count(*) as n_hit,
    sum(greatest(case when (st.n - df + 0.5) > (df + 0.5) then ln((st.n - df + 0.5) / (df + 0.5)) else 1e-6 end, 1e-300)
      * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len.n / st.av))) as score
    from tf join df using (search_id, query_no, term_no) join len using (doc_id), st group by all),
  ranked as (
    select *, 'any' as pass, row_number() over (partition by search_id, query_no order by round(score, 9) desc, doc_id) as rank from scored where {only}
    union all select *, 'all', row_number() over (partition by search_id, query_no order by round(score, 9) desc, doc_id) from scored
      where n_terms >= 2 and n_hit = n_terms and {only}),
  labelled as (select search_id, query_no::varchar as label, doc_id, rank from ranked where rank <= 32 {semantic}),
  fused as (select search_id, doc_id, sum(1 / (60.0 + rank)) as score, string_agg(distinct label, ',' order by label)
    as matched from labelled group by all),
  owned as (select f.*, owner from fused f join docs using (doc_id)),
  damped as (select *, score / (1 + 0.35 * (row_number() over (partition by search_id, owner order by round(score, 12) desc, doc_id) - 1)) as damped
    from owned),
  placed as (select *, row_number() over (partition by search_id order by round(damped, 12) desc, round(score, 12) desc, doc_id) as place from damped)
"""


BM25_SQL = bm25_sql(DOCS_SQL)

# words of the given tables' language with the stem of a word asked for
FAMILIES = {
    "license": "licenses licensed licensing licenser licensers licensable".split(),
    "version": "versions versioned versioning versional".split(),
    "token": "tokens tokenize tokenized tokenizer tokenizes tokenizing tokenization".split(),
    "public": "publication publications publicity publically".split(),
    "key": "keys keyed keying".split(),
    "mit": "mits mitted mitting".split(),
    "que": ["ques"],
    "der": ["ders"],
    "apache": ["apaches"],
}
LINE_CHUNKS_SQL = f"""
  line as (select doc_id, seq, ln, text, length(text) as n, row_number() over (partition by doc_id order by ln) as i from {LINES_SQL}),
  packed(doc_id, i, ln, n, text, start, size) as (
    select doc_id, i, ln, n, text, i, n + 1 from line where i = 1
    union all select l.doc_id, l.i, l.ln, l.n, l.text, case when p.size + l.n > 1800 then l.i else p.start end,
      case when p.size + l.n > 1800 then 0 else p.size end + l.n + 1 from packed p join line l on l.doc_id = p.doc_id and l.i = p.i + 1),
  piece as (select doc_id, min(ln) as lo, max(ln) as hi, string_agg(text, chr(10) order by i) as text from packed group by doc_id, start),
  docs as (select d.doc_id || '#L' || lo || case when hi > lo then '-L' || hi else '' end as doc_id, source as owner,
    split_part(d.text, chr(10), 1) as title, source as section, piece.text from piece join documents d using (doc_id))
"""


def searches(spark):
    return spark.createDataFrame(SEARCHES, SEARCH_SCHEMA)


def document_chunks(spark, d):
    """Each document as one chunk: first line as title, source as section."""
    docs = load(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.split("text", "\n", 2)[0].alias("title"),
        F.col("source").alias("section"), "text",
    )


def _scored(spark, d):
    scored = S.bm25(document_chunks(spark, d), searches(spark), stemmed=False)
    return scored.withColumn("score", F.round("score", 9))


@register(
    "parse_queries",
    r"""
    with q as (select conv_id, turn, text, regexp_extract_all(text, '"([^"]+)"', 1) as ph,
        list_transform(regexp_extract_all(regexp_replace(text, '"[^"]+"', ' ', 'g'), '[\p{L}\p{N}_][\p{L}\p{N}_''.-]*'), lambda w: trim(w, '.''-')) as ws
      from conversations),
    t as (select conv_id, turn, len(ph) + len(list_filter(ws, lambda w: w <> '' and not list_contains(%s, lower(w)))) as n_terms,
      len(list_filter(ws, lambda w: w <> '' and not list_contains(%s, lower(w)))) as n_words from q)
    select conv_id, turn, n_terms::int as n_terms, n_words::int as n_words from t
    """
    % (str(S.STOP_WORDS), str(S.STOP_WORDS)),
)
def parse_queries(spark, d):
    """Turns of conversations as queries."""
    turns = load(spark, d, "conversations")
    phrases = F.size(F.regexp_extract_all("text", F.lit(r'"([^"]+)"'), F.lit(1)))
    words = F.size(S.query_words(F.col("text")))
    return turns.select("conv_id", "turn", (phrases + words).alias("n_terms"), words.alias("n_words"))


@register(
    "tokenize",
    f"select token, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest({TOK.format('text')}) as token from documents) group by 1",
)
def tokenize(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return S.postings(docs).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_docs"))


@register("stem_vocab")
def stem_vocab(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return S.stem_vocab(S.postings(docs)).groupBy("stem").agg(F.count("*").alias("n_words"), F.min("token").alias("first_word"))


@register(
    "bm25_or",
    f"with {BM25_SQL} select search_id, query_no, doc_id, round(score, 4) as score, rank from ranked where pass = 'any' and rank <= 32",
)
def bm25_or(spark, d):
    top = S.top_ranked(_scored(spark, d), ["search_id", "query_no"], 32)
    return top.select("search_id", "query_no", F.col("chunk_id").alias("doc_id"), F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register(
    "bm25_and",
    f"with {BM25_SQL} select search_id, query_no, doc_id, round(score, 4) as score, rank from ranked where pass = 'all' and rank <= 32",
)
def bm25_and(spark, d):
    top = S.passes(_scored(spark, d), 32).filter("pass = 'all'")
    return top.select("search_id", "query_no", F.col("chunk_id").alias("doc_id"), F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register(
    "phrase_match",
    f"with {BM25_SQL} select search_id, query_no, term_no, doc_id, tf::double as tf from tf where (search_id, query_no, term_no) in ((1, 2, 0), (3, 1, 0))",
)
def phrase_match(spark, d):
    occurrences = S.postings(document_chunks(spark, d))
    phrases = S.query_tokens(S.parse_queries(searches(spark))).filter("n_tok > 1")
    tf = S.term_matches(occurrences, phrases)
    return tf.select("search_id", "query_no", "term_no", F.col("chunk_id").alias("doc_id"), F.col("tf").cast("double").alias("tf"))


def _fused(spark, d):
    ranked = S.passes(_scored(spark, d), 32).withColumn("label", F.col("query_no").cast("string"))
    return S.rrf(ranked, ["search_id", "chunk_id"], "label")


@register("rrf_fusion", f"with {BM25_SQL} select search_id, doc_id, round(score, 9) as score, matched from fused")
def rrf_fusion(spark, d):
    fused = _fused(spark, d)
    return fused.select("search_id", F.col("chunk_id").alias("doc_id"), F.round("score", 9).alias("score"), F.array_join("matched", ",").alias("matched"))


@register("diversify", f"with {BM25_SQL} select search_id, place::int as place, doc_id, owner as source, round(score, 9) as score from placed where place <= 8")
def diversify(spark, d):
    owner = document_chunks(spark, d).select("chunk_id", F.col("doc_id").alias("source"))
    hits = _fused(spark, d).withColumn("score", F.round("score", 12)).join(owner, "chunk_id")
    best = S.diversify(hits, 8, ["search_id"], "source")
    return best.select("search_id", "place", F.col("chunk_id").alias("doc_id"), "source", F.round("score", 9).alias("score"))


@register(
    "search_documents",
    f"""
    with recursive {bm25_sql(LINE_CHUNKS_SQL.strip(), FAMILIES)}
    select search_id, place::int as place, doc_id as chunk_id, owner as doc_id, round(score * 1000, 2) as score,
      'q00000' || replace(matched, ',', ',q00000') as matched from placed where place <= 8
    """,
)
def search_documents(spark, d):
    """Flagship: lines as blocks, blocks packed into chunks, stemmed ranking, fusion and diversification by source."""
    docs = load(spark, d, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    chunks = C.line_chunks(docs, carry=["title", "source"])
    named = chunks.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("#"), "anchor").alias("chunk_id"), F.col("source").alias("doc_id"), "title",
        F.col("source").alias("section"), "text",
    )
    hits = S.search(durable(named), searches(spark))
    return hits.select("search_id", "place", "chunk_id", "doc_id", "score", F.array_join("matched", ",").alias("matched"))


NAMED_DOCS_SQL = DOCS_SQL.replace("source as owner", "'doc-' || doc_id as owner")
SEMANTIC_SQL = """
    union all select search_id, '~semantic', vec_id, rank from (
      select search_id, vec_id, row_number() over (partition by search_id order by round(sim, 9) desc, vec_id) as rank from (
        select s.search_id, n.vec_id, max(list_cosine_similarity(e.embedding::double[], n.embedding::double[])) as sim
        from (select distinct search_id from asked) s join embeddings e on e.vec_id in (s.search_id, s.search_id + 10), embeddings n
        join documents on doc_id = n.vec_id where source not in ('src1', 'src2') group by all)) where rank <= 32
"""


@register(
    "search_results",
    rf"""
    with {bm25_sql(NAMED_DOCS_SQL, FAMILIES, "doc_id in (select doc_id from documents where source not in ('src1', 'src2'))", SEMANTIC_SQL)},
    hit as (select * from placed where place <= 8),
    word as (select search_id, list(distinct token) as words from q group by 1),
    part as (select h.search_id, h.place, matched, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as p, words
      from hit h join documents using (doc_id) join word using (search_id)),
    mark as (select *, list_transform(p, lambda x: case when len(list_intersect({TOK.format('x')}, words)) > 0 then 1 else 0 end) as f from part),
    win as (select *, list_transform(range(1, greatest(len(p) - 27, 1) + 1), lambda s: list_sum(f[s : s + 27])) as n from mark),
    best as (select *, list_position(n, list_max(n)) as b, array_to_string(p, ' ') as flat from win),
    snip as (select search_id, place, case when matched = '~semantic' then substr(flat, 1, 220) || case when length(flat) > 220 then ' …' else '' end
      else case when b > 1 then '… ' else '' end || array_to_string(list_transform(range(b, least(b + 28, len(p) + 1)),
        lambda i: case when f[i] = 1 then '«' || p[i] || '»' else p[i] end), ' ') || case when b + 27 < len(p) then ' …' else '' end end as snippet from best),
    line as (select doc_id, ln, lower(text) as t from {LINES_SQL}),
    stem(search_id, stems) as (values (1, ['licen', 'versi', 'apach']), (2, ['mit', 'licen', 'token', 'publi', 'key']), (3, ['versi', 'que', 'der'])),
    cnt as (select search_id, place, ln, len(list_filter(stems, lambda s: contains(t, s))) as n, count(*) over w as m,
      max(len(list_filter(stems, lambda s: contains(t, s)))) over w as most from hit join line using (doc_id) join stem using (search_id)
      window w as (partition by search_id, place)),
    pin as (select *, row_number() over (partition by search_id, place order by ln) as rn from cnt where n = most and n > 0 and m > 1),
    pins as (select search_id, place, string_agg('L' || ln, ',' order by ln) as best from pin where rn <= 3 group by all),
    span as (select doc_id, min(seq)::bigint as first_seq, max(seq)::bigint as last_seq from {LINES_SQL} group by 1)
    select search_id, place::int as place, 'doc-' || doc_id || '#L' || first_seq + 1 || '-L' || last_seq + 1 as ref, source || '/doc-' || doc_id || '.txt' as path,
      split_part(text, chr(10), 1) as title, first_seq, last_seq, snippet, coalesce(best, '') as best, round(score * 1000, 2) as score,
      case when matched[1] = '~' then matched else 'q00000' || replace(replace(matched, ',', ',q00000'), 'q00000~', '~') end as matched
    from hit join documents using (doc_id) join span using (doc_id) join snip using (search_id, place) left join pins using (search_id, place)
    """,
)
def search_results(spark, d):
    """Documents of all but two sources as a reader gets them: by words and by meaning, with snippets and the lines that answer."""
    source = load(spark, d, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    docs = source.select(name.alias("doc_id"), F.concat("source", F.lit("/"), name, F.lit(".txt")).alias("path"),
                         F.when(F.col("source").isin("src1", "src2"), "csv").otherwise("txt").alias("doc_type"))
    blocks = durable(B.line_blocks(source))
    span = blocks.groupBy("doc_id").agg(F.min("seq").cast("long").alias("first_seq"), F.max("seq").cast("long").alias("last_seq"))
    at = F.concat(F.lit("L"), F.col("first_seq") + 1, F.lit("-L"), F.col("last_seq") + 1)
    title = F.split("text", "\n", 2)[0]
    chunks = source.join(span, "doc_id").select(
        F.col("doc_id").alias("chunk_id"), name.alias("doc_id"), at.alias("anchor"), title.alias("title"),
        F.col("source").alias("section"), "first_seq", "last_seq", "text",
    )
    e = load(spark, d, "embeddings")
    asked = e.filter("vec_id in (1, 2, 3, 11, 12, 13)").select((F.col("vec_id") % 10).cast("int").alias("search_id"), "embedding")
    found = S.search_results(
        durable(chunks), blocks.withColumn("doc_id", name), docs, searches(spark), 8, ["txt"], "*", e.withColumnRenamed("vec_id", "chunk_id"), asked
    )
    return found.select(
        "search_id", "place", "ref", "path", "title", "first_seq", "last_seq", "snippet", F.array_join("best", ",").alias("best"), "score",
        F.array_join("matched", ",").alias("matched"),
    )


@register(
    "pin_blocks",
    f"""
    with b as (select doc_id, seq, anchor, lower(text) as t from {LINES_SQL}),
    n as (select doc_id, seq, anchor, (contains(t, 'licen'))::int + (contains(t, 'versi'))::int + (contains(t, 'apach'))::int as n from b),
    c as (select *, count(*) over (partition by doc_id) as m, max(n) over (partition by doc_id) as most from n),
    r as (select *, row_number() over (partition by doc_id order by seq) as rn from c where n = most and n > 0 and m > 1)
    select doc_id, seq::bigint as seq, anchor, n::int as n from r where rn <= 3
    """,
)
def pin_blocks(spark, d):
    """Documents as hits of one search; their lines are the blocks."""
    blocks = B.line_blocks(load(spark, d, "documents"))
    hits = blocks.groupBy("doc_id").agg(F.min("seq").cast("bigint").alias("first_seq"), F.max("seq").cast("bigint").alias("last_seq"))
    hits = hits.withColumn("chunk_id", F.col("doc_id")).withColumn("search_id", F.lit(1))
    pinned = S.pin_blocks(hits, blocks, searches(spark).filter("search_id = 1"))
    return pinned.select(F.col("chunk_id").alias("doc_id"), "seq", "anchor", F.col("n").cast("int").alias("n"))


@register(
    "snippet",
    r"""
    with d as (select doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as p from documents where regexp_matches(text, '(?i)\b(license|version)\b')),
    h as (select *, list_transform(p, lambda x: case when regexp_matches(lower(x), '(^|[^a-z0-9])(license|version)($|[^a-z0-9])') then 1 else 0 end) as f from d),
    c as (select *, list_transform(range(1, greatest(len(p) - 27, 1) + 1), lambda s: list_sum(f[s : s + 27])) as n from h),
    b as (select *, list_position(n, list_max(n)) as best from c)
    select doc_id, case when best > 1 then '… ' else '' end || array_to_string(list_transform(range(best, least(best + 28, len(p) + 1)),
      lambda i: case when f[i] = 1 then '«' || p[i] || '»' else p[i] end), ' ') || case when best + 27 < len(p) then ' …' else '' end as snippet from b
    """,
)
def snippet(spark, d):
    docs = load(spark, d, "documents").filter(F.col("text").rlike(r"(?iu)\b(license|version)\b"))
    words = F.array(F.lit("license"), F.lit("version"))
    return S.snippets(docs, "text", words).select("doc_id", "snippet")


@register(
    "exact_search",
    f"""
    with m as (select doc_id, seq, anchor, text, strpos(lower(text), 'license') as p from {LINES_SQL} where contains(lower(text), 'license'))
    select doc_id, seq, anchor, '…' || trim(regexp_replace(substr(text, greatest(p - 70, 1)::int, (p + 7 + 70 - greatest(p - 70, 1))::int), '\\s+', ' ', 'g')) || '…'
      as context, (select count(*) from m) as n_blocks from m order by doc_id, seq limit 30
    """,
)
def exact_search(spark, d):
    total, lines = S.exact_search(B.line_blocks(load(spark, d, "documents")), "License")
    return lines.withColumn("n_blocks", total.select("n_blocks").scalar())


@register(
    "regex_search",
    f"""
    with m as (select doc_id, seq, anchor, regexp_extract(text, '(?i)v(er)?sion [0-9.]+', 0) as hit from {LINES_SQL}
      where regexp_matches(text, '(?i)v(er)?sion [0-9.]+'))
    select doc_id, seq, anchor, (select count(*) from m) as n_blocks from m order by doc_id, seq limit 30
    """,
)
def regex_search(spark, d):
    total, lines = S.exact_search(B.line_blocks(load(spark, d, "documents")), "v(er)?sion [0-9.]+", regex=True)
    return lines.select("doc_id", "seq", "anchor", total.select("n_blocks").scalar().alias("n_blocks"))


@register(
    "filter_docs",
    "select page_id, path from (select page_id, regexp_replace(url, '^https?://', '') as path, case when url like '%.html' then 'html' "
    "else 'txt' end as doc_type from pages) where doc_type = 'html' and regexp_matches(path, '^blog\\..*/e[mn]/[0-9]..\\.html$')",
)
def filter_docs(spark, d):
    kind = F.when(F.col("url").endswith(".html"), "html").otherwise("txt")
    docs = load(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"), kind.alias("doc_type"))
    return S.filter_docs(docs, ["html"], "blog.*/e[mn]/[0-9]??.html").select("page_id", "path")


QUERY_VECTORS = [[math.sin(i) for i in range(1, 65)], [math.cos(i) for i in range(1, 65)]]
QV_SQL = "list_transform(range(1, 65), lambda i: {0}(i)::double)"
SIM_SQL = "list_cosine_similarity(embedding::double[], " + QV_SQL + ")"


@register(
    "vector_topk",
    f"select vec_id, round(greatest({SIM_SQL.format('sin')}, {SIM_SQL.format('cos')}), 5) as sim from embeddings "
    f"order by greatest({SIM_SQL.format('sin')}, {SIM_SQL.format('cos')}) desc, vec_id limit 20",
)
def vector_topk(spark, d):
    near = V.nearest(load(spark, d, "embeddings"), QUERY_VECTORS, 20)
    return near.select("vec_id", F.round("sim", 5).alias("sim"))


@register(
    "vector_search",
    """
    with q as (select s.vec_id as search_id, e.embedding::double[] as v from embeddings s join embeddings e on e.vec_id between s.vec_id and s.vec_id + 1
      where s.vec_id < 20),
    n as (select vec_id, embedding::double[] as v from embeddings join documents on doc_id = vec_id where source not in ('src1', 'src2')),
    m as (select search_id, vec_id, max(list_cosine_similarity(q.v, n.v)) as sim from q, n group by all),
    r as (select *, row_number() over (partition by search_id order by round(sim, 9) desc, vec_id) as rank from m)
    select search_id, rank::int as rank, vec_id, round(sim, 5) as sim from r where rank <= 10
    """,
)
def vector_search(spark, d):
    """Twenty searches of two phrasings each in one job, among the documents of all but two sources."""
    e = load(spark, d, "embeddings")
    both = F.explode(F.array(F.col("vec_id"), F.col("vec_id") - 1))
    asked = e.filter("vec_id <= 20").select(both.alias("search_id"), "embedding").filter("search_id between 0 and 19")
    allowed = load(spark, d, "documents").filter("source not in ('src1', 'src2')").select(F.col("doc_id").alias("vec_id"))
    near = V.nearest_each(e.join(allowed, "vec_id", "left_semi"), asked, 10)
    return near.select("search_id", "rank", "vec_id", F.round("sim", 5).alias("sim"))


@register(
    "l2_normalize",
    "select vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::double))) / sqrt(list_sum(list_transform(embedding, "
    "lambda x: x::double * x::double))), 6) as l1 from embeddings",
)
def l2_normalize(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"))


@register(
    "hybrid_rrf",
    f"""
    with t as (select vec_id, row_number() over (order by {SIM_SQL.format('sin')} desc, vec_id) as r from embeddings),
    w as (select vec_id, row_number() over (order by {SIM_SQL.format('cos')} desc, vec_id) as r from embeddings),
    u as (select *, 'q1' as label from t where r <= 32 union all select *, '~semantic' from w where r <= 32)
    select vec_id, round(sum(1 / (60.0 + r)), 9) as score, string_agg(label, ',' order by label) as matched from u group by 1
    """,
)
def hybrid_rrf(spark, d):
    """A ranking that stands for words and one by meaning, fused under their labels."""
    e = load(spark, d, "embeddings")

    def ranking(vector, label):
        near = V.nearest(e, [vector], 32).select("vec_id", F.col("sim").alias("score"), F.lit(1).alias("search_id"))
        return S.top_ranked(near, ["search_id"], 32, "vec_id").withColumn("label", F.lit(label))

    both = ranking(QUERY_VECTORS[0], "q1").unionByName(ranking(QUERY_VECTORS[1], "~semantic"))
    fused = S.rrf(both, ["search_id", "vec_id"], "label")
    return fused.select("vec_id", F.round("score", 9).alias("score"), F.array_join("matched", ",").alias("matched"))


@register(
    "embedding_backlog",
    "select doc_id, md5(substr(whole, 1, 2000)) as input, greatest(length(whole) - 2000, 0)::bigint as left_out from (select doc_id, "
    "split_part(text, chr(10), 1) || ' | ' || source || chr(10) || text as whole from documents) where doc_id not in (select vec_id from embeddings)",
)
def embedding_backlog(spark, d):
    chunks = document_chunks(spark, d)
    done = load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("m").alias("model"))
    todo = V.embedding_backlog(chunks, done, "m")
    return todo.select(F.col("chunk_id").alias("doc_id"), F.md5("input").alias("input"), "left_out")
