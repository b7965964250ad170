"""Reference resolution and reading over lines of documents and sheets of parts."""

from pyspark.sql import functions as F

from attestra.functions.anchors import parse_ref
from attestra.operators import refs as R
from attestra.operators.chunks import make_chunks
from attestra.operators.results import result_rows
from attestra.plans.derived import LINES_SQL, part_cells, sectioned
from attestra.plans.registry import register
from attestra.plans.source_queries import UNESC, _block_sql
from attestra.plans.table_queries import CHUNKS_SQL
from attestra.session import durable, load
from attestra.sources import blocks as B
from attestra.sources import grid, html



def line_blocks(spark, d):
    docs = load(spark, d, "documents")
    return B.line_blocks(docs.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))))


def doc_rows(spark, d):
    docs = load(spark, d, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return docs.select(name.alias("doc_id"), F.concat("source", F.lit("/"), name, F.lit(".txt")).alias("path"))


@register(
    "parse_ref",
    "select l_orderkey, l_linenumber, case k when 3 then null else 'part-' || l_partkey end as doc, case k when 0 then 'L' || l_linenumber "
    "when 1 then 'Sheet!A' || l_linenumber else null end as anchor, k <> 3 as ok from (select *, l_orderkey % 4 as k from lineitem)",
)
def parse_refs(spark, d):
    n = load(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") % 4)
    doc = F.concat(F.lit("part-"), F.col("l_partkey").cast("string"))
    line = F.col("l_linenumber").cast("string")
    ref = (
        F.when(F.col("k") == 0, F.concat(F.lit("@"), doc, F.lit("#L"), line))
        .when(F.col("k") == 1, F.concat(doc, F.lit("#Sheet!A"), line, F.lit(" ")))
        .when(F.col("k") == 2, doc)
        .otherwise(F.concat(F.lit("Part "), doc))
    )
    return n.select("l_orderkey", "l_linenumber", parse_ref(ref).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@register(
    "find_doc",
    """
    with docs as (select page_id, 'p' || page_id as doc_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') as path from pages),
    tails as (select regexp_extract(path, '([^/]*)$', 1) as tail, count(*) as n, min(doc_id) as doc_id from docs group by 1),
    keys as (select page_id, case page_id % 3 when 0 then doc_id when 1 then path else upper(regexp_extract(path, '([^/]*)$', 1)) end as k from docs)
    select k as doc_key, coalesce(any_value(i.doc_id), min(p.doc_id), any_value(t.doc_id)) as doc_id from keys
      left join docs i on keys.k = i.doc_id left join docs p on keys.k = p.path
      left join (select * from tails where n = 1) t on lower(keys.k) = t.tail
    group by 1 having coalesce(any_value(i.doc_id), min(p.doc_id), any_value(t.doc_id)) is not null
    """,
)
def find_doc(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    docs = load(spark, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"), path.alias("path"))
    tail = F.upper(F.regexp_extract("path", r"([^/]*)$", 1))
    key = F.when(F.col("page_id") % 3 == 0, F.col("doc_id")).when(F.col("page_id") % 3 == 1, F.col("path")).otherwise(tail)
    return R.find_docs(docs.select(key.alias("doc_key")), docs)


@register(
    "resolve_exact",
    """
    select 'o' || o_custkey as doc_id, case when o_orderkey % 2 = 0 then 't' || o_orderkey else 't' || o_orderkey || '.R' || l_linenumber end as target,
      (l_orderkey * 100000 + l_linenumber * 10000 + l_partkey)::bigint as seq
    from lineitem join orders on l_orderkey = o_orderkey
    """,
)
def resolve_exact(spark, d):
    """Orders as tables of customer documents: even ones are asked for as a whole (children), odd ones row by row."""
    o = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    table = F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))
    row = F.concat(table, F.lit(".R"), F.col("l_linenumber").cast("string"))
    blocks = o.select(
        F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("doc_id"),
        (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("seq"),
        row.alias("anchor"),
        F.when(F.col("o_orderkey") % 2 == 0, table).otherwise(row).alias("target"),
    )
    return R.resolve(blocks.select("doc_id", "target"), blocks.select("doc_id", "seq", "anchor"))


@register(
    "resolve_cells",
    """
    select 'book' || s // 4 as doc_id, t.target as target, (p_partkey % 400 + 5)::bigint as r, 'Parts ' || s as sheet
    from (select p_partkey, p_partkey // 400 as s from part) p join (
      select p_partkey as k, p_partkey // 400 as ts, '''Parts ' || p_partkey // 400 || '''!$B' || (p_partkey % 400 + 7) || ':D' || (p_partkey % 400 + 5)
        as target, p_partkey % 400 + 5 as lo from part) t
      on s = ts and p_partkey % 400 + 5 between lo and lo + 2
    """,
)
def resolve_cells(spark, d):
    """For every part the range of its row and the two below, written backwards."""
    cells = part_cells(spark, d)
    blocks = grid.sheet_blocks(cells, grid.detect_header(cells)).filter("kind = 'row'")
    sheet_no = F.regexp_extract("sheet", r"(\d+)$", 1).cast("long")
    blocks = durable(blocks.withColumn("seq", sheet_no * grid.ROW_SPACE + F.col("r")).filter("r > 4"))
    k = F.col("p_partkey")
    s = F.floor(k / 400)
    targets = load(spark, d, "part").select(
        F.concat(F.lit("book"), F.floor(s / 4).cast("string")).alias("doc_id"),
        F.concat(
            F.lit("'Parts "), s.cast("string"), F.lit("'!$B"), (k % 400 + 7).cast("string"), F.lit(":D"), (k % 400 + 5).cast("string")
        ).alias("target"),
    )
    at = R.resolve(targets, blocks)
    return at.join(blocks.select("doc_id", "seq", "r", "sheet"), ["doc_id", "seq"]).select("doc_id", "target", "r", "sheet")


@register(
    "resolve_lines",
    f"""
    with b as (select 'doc-' || doc_id as doc_id, seq, ln from {LINES_SQL}),
    t as (select 'doc-' || doc_id as doc_id, 1 + doc_id % 7 as lo, 1 + doc_id % 7 + doc_id % 5 * 100 as hi from documents)
    select doc_id, 'L' || lo || '-L' || hi as target, seq::bigint as seq from b join t using (doc_id) where ln between lo and hi
    """,
)
def resolve_lines(spark, d):
    blocks = line_blocks(spark, d)
    n = F.regexp_extract("doc_id", r"(\d+)$", 1).cast("long")
    lo, hi = 1 + n % 7, 1 + n % 7 + n % 5 * 100
    target = F.concat(F.lit("L"), lo.cast("string"), F.lit("-L"), hi.cast("string"))
    targets = doc_rows(spark, d).select("doc_id", target.alias("target"))
    # a one-line range is written as a range, so it never equals an anchor
    return R.resolve(targets, blocks).select("doc_id", "target", F.col("seq").cast("bigint").alias("seq"))


@register(
    "resolve_range",
    """
    with l as (select l_orderkey as k, l_linenumber as n, min(l_partkey) as p from lineitem group by 1, 2),
    m as (select k, min(n) as a, max(n) as b from l group by 1)
    select 'o' || k as doc_id, 'p' || b || '-p' || a as target, n::bigint as seq from l join m using (k) where a < b
    """,
)
def resolve_range(spark, d):
    """The paragraphs of an order between its last and its first line, ends swapped."""
    lines = load(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("doc_id"), "l_linenumber").distinct()
    para = lambda c: F.concat(F.lit("p"), c.cast("string"))
    blocks = lines.select("doc_id", F.col("l_linenumber").cast("bigint").alias("seq"), para(F.col("l_linenumber")).alias("anchor"))
    ends = lines.groupBy("doc_id").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b")).filter("a < b")
    return R.resolve(ends.select("doc_id", F.concat(para(F.col("b")), F.lit("-"), para(F.col("a"))).alias("target")), blocks)


@register(
    "unresolved_refs",
    """
    with n as (select doc_id, len(string_split(text, chr(10))) as n from documents)
    select 'Doc ' || doc_id as ref, 'malformed' as reason from n where doc_id % 4 = 0
    union all select 'note-' || doc_id || '#L1', 'unknown document' from n where doc_id % 4 = 1
    union all select 'doc-' || doc_id || '#L' || (n + 1), 'anchor not found' from n where doc_id % 4 = 2
    """,
)
def unresolved_refs(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    i = F.col("doc_id").cast("string")
    ref = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Doc "), i))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("note-"), i, F.lit("#L1")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("doc-"), i, F.lit("#L"), (F.col("n") + 1).cast("string")))
        .otherwise(F.concat(F.lit("doc-"), i, F.lit("#L1")))
    )
    return R.unresolved(docs.select(ref.alias("ref")), doc_rows(spark, d), line_blocks(spark, d))


@register(
    "read_context",
    f"""
    with b as (select 'doc-' || doc_id as doc_id, ln, anchor, text from {LINES_SQL}),
    t as (select 'doc-' || doc_id || '#L2' as ref, 'doc-' || doc_id as doc_id from documents),
    e as (select doc_id from b where ln = 2)
    select ref, md5(string_agg('[' || anchor || '] ' || text, chr(10) order by ln)) as body from t join e using (doc_id) join b using (doc_id)
    where ln between 1 and 3 group by 1
    union all select ref, md5('(unresolved: anchor not found)') from t where doc_id not in (select doc_id from e)
    union all select 'Doc ' || doc_id, md5('(unresolved: malformed)') from documents where doc_id % 5 = 0
    union all select 'calc:' || n_nationkey, case when n_nationkey = 7 then md5('SQL: select n_name from nation' || chr(10) || 'Files: data/nation.parquet' || chr(10)
        || (select string_agg('{{"n_name":"' || n_name || '"}}', chr(10) order by n_name) from nation)) else md5('(unresolved: no such result)') end from nation
    """,
)
def read_context(spark, d):
    """The second line of every document with one line around it, refs that are dead or malformed, and saved results."""
    rows = doc_rows(spark, d)
    nation = load(spark, d, "nation")
    refs = rows.select(F.concat("doc_id", F.lit("#L2")).alias("ref"))
    refs = refs.unionByName(load(spark, d, "documents").filter("doc_id % 5 = 0").select(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("ref")))
    refs = refs.unionByName(nation.select(F.concat(F.lit("calc:"), F.col("n_nationkey").cast("string")).alias("ref")))
    saved = result_rows(nation.select("n_name"), ["n_name"]).withColumn("result_id", F.lit(7))
    info = spark.range(1).select(F.lit(7).alias("result_id"), F.lit("select n_name from nation").alias("sql"), F.array(F.lit("data/nation.parquet")).alias("source_files"))
    read = R.read_refs(refs, rows, line_blocks(spark, d), context=1, max_chars=1000000, results=info, rows=saved)
    return read.select("ref", F.md5("text").alias("body"))


@register(
    "char_budget",
    f"""
    select doc_id, count(*) as n_lines, max(used)::bigint as used from (
      select doc_id, sum(length(text) + 1) over (partition by doc_id order by seq) as used from {LINES_SQL}) where used <= 1000 group by 1
    """,
)
def char_budget(spark, d):
    lines = B.line_blocks(load(spark, d, "documents"))
    kept = R.within_budget(lines, ["doc_id"], ["seq"], "text", 1000)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("used").alias("used"))


@register(
    "outline",
    f"""
    with b as (select page_id as doc_id, unnest(string_split({_block_sql()}, chr(1))) as part,
        generate_subscripts(string_split({_block_sql()}, chr(1)), 1) as i from pages),
    t as (select doc_id, i, regexp_extract(part, '^(h[1-6]|li|tr|pp):', 1) as tag,
        trim(regexp_replace({UNESC.format("regexp_replace(part, '^(?:h[1-6]|li|tr|pp):', '')")}, '\\s+', ' ', 'g')) as body from b),
    k as (select * from t where body <> ''),
    h as (select *, last_value(case when tag like 'h%' then i end ignore nulls) over (partition by doc_id order by i rows unbounded preceding) as hd from k)
    select doc_id, (hd - 1)::int as seq, repeat('  ', (max(case when i = hd then substr(tag, 2, 1)::int end) - 1)::int) || '[p' || hd || '] ' || max(case when i = hd then body end)
      || '  (' || (count(*) - 1) || ' blocks)' as item from h where hd is not null group by doc_id, hd
    """,
)
def outline(spark, d):
    """Headings of pages with the blocks under them."""
    blocks = html.html_sections(html.html_blocks(load(spark, d, "pages")))
    addressed = blocks.withColumn("anchor", F.concat(F.lit("p"), (F.col("seq") + 1).cast("string")))
    return R.outline(addressed, "html").select("doc_id", "seq", "item")


@register(
    "outline_lines",
    f"select doc_id, seq, '[' || anchor || '] ' || substr(text, 1, 100) as item from (select *, row_number() over (partition by doc_id order by seq) "
    f"as rn from {LINES_SQL}) where rn <= 20",
)
def outline_lines(spark, d):
    return R.outline(B.line_blocks(load(spark, d, "documents")), "csv").select("doc_id", "seq", "item")


@register(
    "corpus_stats",
    f"""
    select 'docs' as part, count(*) as n from documents union all select 'blocks', count(*) from {LINES_SQL}
    union all select 'vectors', count(*) from embeddings union all select 'tables', count(distinct p_brand) from part
    """,
)
def corpus_stats(spark, d):
    docs = load(spark, d, "documents")
    return R.corpus_stats(
        docs=docs, blocks=B.line_blocks(docs), vectors=load(spark, d, "embeddings"), tables=load(spark, d, "part").select("p_brand").distinct()
    )


@register("chunk_stats", CHUNKS_SQL + "select doc_id, count(*) as n_chunks, max(n_chars) as longest from c group by 1")
def chunk_stats(spark, d):
    """Sizes of the chunks of sectioned documents."""
    chunks = make_chunks(B.segment_text(sectioned(spark, d)))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("text")).alias("longest"))
