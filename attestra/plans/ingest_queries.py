"""The ingest job over two states of files derived from documents, pages and suppliers."""

import uuid

from pyspark.sql import functions as F

from attestra.operators.corpus import Corpus
from attestra.plans.registry import register
from attestra.session import load, scratch_folder


def _files(spark, d, state, lists):
    """Documents as Markdown and pages as they are, or suppliers as a list per nation. Of five numbers in a row the first comes with the
    second state, the second goes, the third is changed and the fourth only touched."""
    second = F.lit(state == 2)
    n = F.col("n")
    flat = F.trim(F.regexp_replace("text", r"[\s\x0b]+", " "))
    head = F.concat(F.lit("---\ntitle: T"), n.cast("string"), F.lit("\nshelf: 4\n---\n# Head "), n.cast("string"), F.lit("\n\n"))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("n"), "text").select("n", F.format_string("docs/d%d.md", "n").alias("path"), F.concat(head, flat).alias("text"))
    pages = load(spark, d, "pages").select(F.col("page_id").alias("n"), F.format_string("pages/p%d.html", "page_id").alias("path"), F.col("html").alias("text"))
    files = docs.unionByName(pages)
    if lists:
        rec = F.concat_ws(";", F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string"))
        rows = load(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("n")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", rec.alias("rec")))).alias("rs"))
        body = F.concat(F.lit("Key;Name;Name\n"), F.array_join(F.transform("rs", lambda x: x["rec"]), "\n"))
        files = rows.select("n", F.format_string("lists/s%d.csv", "n").alias("path"), body.alias("text"))
    files = files.filter(F.when(second, n % 5 != 1).otherwise(n % 5 != 0))
    text = F.when(second & (n % 5 == 2), F.concat("text", F.lit("\nagain;more;1"))).otherwise(F.col("text"))
    files = files.withColumn("text", text).withColumn("mtime", F.when(second & n.isNotNull() & (n % 5).isin(2, 3), 2.0).otherwise(1.0))
    return files.select("path", F.length("text").cast("long").alias("size"), "mtime", F.sha2("text", 256).alias("sha256"), "text")


def _corpus(spark, d, lists):
    corpus = Corpus(spark, f"{scratch_folder(spark)}/{uuid.uuid4().hex}")
    for state in (1, 2):
        corpus.ingest(_files(spark, d, state, lists))
    return corpus


@register(
    "ingest_states",
    r"""
    with f as (select doc_id as n, 'd' || doc_id as id, 'docs/d' || doc_id || '.md' as path, 'md' as kind, trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')) as t from documents
      union all select page_id, 'p' || page_id, 'pages/p' || page_id || '.html', 'html', html from pages)
    select id as doc_id, path, case when kind = 'md' then 'T' || n end as title, (kind = 'md')::int as n_meta,
      case when n % 5 in (0, 2) then 2 else 1 end::bigint as content, case when n % 5 in (2, 3) then 2.0 else 1.0 end::double as mtime,
      case when kind = 'md' then case when t = '' and n % 5 <> 2 then 1 else 2 end end::bigint as n_blocks,
      case when kind = 'md' then case when t <> '' and length('Head ' || n) + 1 + length(t) + case when n % 5 = 2 then length(chr(10) || 'again;more;1') else 0 end > 1800 then 2 else 1 end end::bigint as n_chunks
    from f where n % 5 <> 1
    """,
)
def ingest_states(spark, d):
    """The documents after the second state. Titles, blocks and chunks of pages are left to their own queries."""
    corpus = _corpus(spark, d, False)
    blocks = corpus.read("blocks").groupBy("doc_id").agg(F.count("*").alias("n_blocks"))
    chunks = corpus.read("chunks").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    rows = corpus.read("docs").join(blocks, "doc_id", "left").join(chunks, "doc_id", "left")
    md = lambda c: F.when(F.col("doc_type") == "md", F.col(c)).alias(c)
    return rows.select("doc_id", "path", md("title"), F.size("meta").alias("n_meta"), "content", "mtime", md("n_blocks"), md("n_chunks"))


@register(
    "ingest_tables",
    """
    with c as (select s_nationkey as k, count(*) as n from supplier where s_nationkey % 5 <> 1 group by 1),
    t as (select k, n, unnest([1, 2, 3]) as c from c)
    select 's' || k || '__rows' as table_name, c, ['key', 'name', 'name_2'][c] as name, ['Key', 'Name', 'Name'][c] as orig,
      case c when 1 then case when k % 5 <> 2 then 'BIGINT' when n >= 9 then 'DOUBLE' else 'VARCHAR' end when 2 then 'VARCHAR' else 'DOUBLE' end as type,
      n + case when k % 5 = 2 then 1 else 0 end as n
    from t
    """,
)
def ingest_tables(spark, d):
    """The columns of the tables after the second state; one more row, with a word for a number, in every fifth."""
    return _corpus(spark, d, True).read("columns").select("table_name", "c", "name", "orig", "type", "n")
