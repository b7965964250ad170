"""Cells to typed tables over the given tables."""

from pyspark.sql import functions as F

from attestra.functions.text import sql_ident
from attestra.operators import chunks as C
from attestra.operators import typed as T
from attestra.plans.derived import SECTIONED_SQL, PART_CELLS_SQL, part_cells, sectioned
from attestra.plans.registry import register
from attestra.plans.text_functions import ident_sql
from attestra.session import durable, load
from attestra.sources import blocks as B
from attestra.sources import grid


@register(
    "coerce_cell",
    """
    select l_orderkey, l_linenumber, case k when 0 then l_extendedprice::varchar when 1 then l_partkey::varchar
        when 2 then (l_discount * 100)::int || '%' when 3 then l_partkey || '-' || l_suppkey end as v,
      case k when 0 then 'f' when 1 then 'i' when 2 then 's' when 3 then 's' end as kind
    from (select *, l_orderkey % 5 as k from lineitem)
    """,
)
def coerce_cell(spark, d):
    """Prices with currency and commas, signed counts, percentages, ranges, blanks."""
    items = load(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") % 5)
    price = F.format_number("l_extendedprice", 2)
    text = (
        F.when(F.col("k") == 0, F.concat(F.lit(" $"), price))
        .when(F.col("k") == 1, F.concat(F.lit("+"), F.col("l_partkey").cast("string"), F.lit("\t")))
        .when(F.col("k") == 2, F.concat(F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"), F.lit("%")))
        .when(F.col("k") == 3, F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
        .otherwise("  ")
    )
    out = items.select("l_orderkey", "l_linenumber", "k", T.coerce_cell(text).alias("x"))
    money = F.when(F.col("k") == 0, F.col("x.v").cast("double").cast("string")).otherwise(F.col("x.v"))
    return out.select("l_orderkey", "l_linenumber", money.alias("v"), F.col("x.kind").alias("kind"))


TYPES_SQL = f"""
    select doc_id, sheet, c, case c when 2 then 'BIGINT' when 5 then 'DOUBLE' when 6 then 'DOUBLE' else 'VARCHAR' end as type,
      count_if(v is not null and not (kind = 's' and lower(trim(v)) in ('', 'n/a')))::bigint as n,
      case when c = 5 and count_if(v = 'n/a') > 0 then 'read as missing: ' || count_if(v = 'n/a') || ' times ''n/a'''
        when c = 6 then 'no number, left empty: ' || count_if(kind = 's') || ' values such as ''on request''' else '' end as notes
    from {PART_CELLS_SQL} where r between 5 and 404 and c <= 7 group by doc_id, sheet, c
    """.replace("when 5 then 'DOUBLE'", "when 5 then 'BIGINT'")


@register("infer_types", TYPES_SQL)
def infer_types(spark, d):
    body = grid.table_body(part_cells(spark, d))
    return T.infer_types(body)


@register(
    "null_tokens",
    "select o_orderpriority as token, count(*) as n, count_if(o_orderkey % 6 <> 5)::bigint as n_null from (select o_orderkey, case "
    "o_orderkey % 6 when 0 then 'N/A' when 1 then '-' when 2 then ' TBD ' when 3 then '—' when 4 then '?' else 'none so far' end as "
    "o_orderpriority from orders) group by 1",
)
def null_tokens(spark, d):
    tokens = F.array(*[F.lit(x) for x in ("N/A", "-", " TBD ", "—", "?", "none so far")])
    o = load(spark, d, "orders").select(F.element_at(tokens, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("token"))
    hit = T.is_placeholder(F.col("token"), F.lit("s"))
    return o.groupBy("token").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_null"))


@register(
    "typed_pivot",
    """
    select 'book' || p_partkey // 1600 as doc_id, 'Parts ' || p_partkey // 400 as sheet, (p_partkey % 400 + 5)::int as r, p_partkey as part_key,
      p_name as name, p_brand as brand, case when p_partkey % 20 = 3 then null else p_size end::bigint as size,
      case when p_partkey % 25 = 7 or p_partkey % 50 = 9 then null else p_retailprice end as retail_price,
      case when p_partkey % 3 = 0 then p_type else '' end as note from part
    """,
)
def typed_pivot(spark, d):
    body = grid.table_body(part_cells(spark, d))
    columns = [
        (2, "part_key", "BIGINT"), (3, "name", "VARCHAR"), (4, "brand", "VARCHAR"), (5, "size", "BIGINT"),
        (6, "retail_price", "DOUBLE"), (7, "note", "VARCHAR"),
    ]
    return T.load_table(body, columns)


@register(
    "unique_names",
    f"""
    with c as (select p_partkey // 64 as t, p_partkey as pos, {ident_sql('p_name')} as ident from part)
    select t, pos, ident, ident || case when row_number() over w > 1 then '_' || row_number() over w else '' end as unique_name
    from c window w as (partition by t, ident order by pos)
    """,
)
def unique_names(spark, d):
    """Part names as the column names of tables of 64 columns."""
    part = load(spark, d, "part")
    cols = part.select(
        F.floor(F.col("p_partkey") / 64).cast("long").alias("t"), F.col("p_partkey").alias("pos"), sql_ident(F.col("p_name")).alias("ident")
    )
    return T.unique_names(cols, ["t"], "pos")


@register(
    "table_names",
    f"""
    select p_partkey as table_no, doc || '__' || name || repeat('_x', (row_number() over (partition by p_partkey // 100, doc || '__' || name
      order by p_partkey) - 1)::int) as table_name
    from (select p_partkey, 'doc_' || p_partkey // 100 as doc, {ident_sql('p_brand')} as name from part)
    """,
)
def table_names(spark, d):
    part = load(spark, d, "part")
    doc = F.concat(F.lit("doc "), F.floor(F.col("p_partkey") / 100).cast("string"))
    tables = part.select(F.col("p_partkey").alias("table_no"), doc.alias("doc_id"), F.col("p_brand").alias("source_name"))
    return T.table_names(tables).select("table_no", "table_name")


@register(
    "catalog",
    f"""
    with y as ({TYPES_SQL}),
    n as (select doc_id, sheet, count(distinct r) as n_rows from {PART_CELLS_SQL} where r between 5 and 404 and c <= 7 group by 1, 2)
    select doc_id || '__' || lower(replace(sheet, ' ', '_')) as table_name, 'data/' || doc_id || '.xlsx' as path, n_rows,
      'part_key bigint ("Part key"), name varchar ("Name"), brand varchar ("Brand"), size bigint ("Size"), retail_price double ("Retail price"), note varchar ("Note")' as columns,
      coalesce((select string_agg(case c when 5 then 'size: ' else 'retail_price: ' end || y.notes, '; ' order by c desc) from y
        where y.doc_id = n.doc_id and y.sheet = n.sheet and y.notes <> ''), '') as notes from n
    """,
)
def catalog(spark, d):
    """The workbooks of parts as a table catalog, searched by name."""
    cells = part_cells(spark, d)
    headers = durable(grid.detect_header(cells))
    body = grid.table_body(cells, headers)
    names = cells.join(headers, ["doc_id", "sheet"]).filter("r = header_row")
    types = T.infer_types(body).join(
        names.select("doc_id", "sheet", "c", F.col("v").alias("orig")), ["doc_id", "sheet", "c"]
    )
    column = F.struct("c", sql_ident(F.col("orig")).alias("name"), "orig", "type")
    meta = types.groupBy("doc_id", "sheet").agg(
        F.array_sort(F.collect_list(column)).alias("columns"),
        F.array_sort(F.collect_list(F.when(F.col("notes") != "", F.concat_ws(": ", sql_ident(F.col("orig")), "notes")))).alias("notes"),
    )
    rows = body.groupBy("doc_id", "sheet").agg(F.countDistinct("r").alias("n_rows"))
    meta = meta.join(rows, ["doc_id", "sheet"]).withColumn("source_name", F.col("sheet"))
    named = T.table_names(meta.withColumn("table_no", F.col("sheet")))
    docs = cells.select("doc_id").distinct().withColumn("path", F.concat(F.lit("data/"), "doc_id", F.lit(".xlsx")))
    listed = T.catalog(named, docs, "parts")
    return listed.select("table_name", "path", "n_rows", "columns", F.array_join("notes", "; ").alias("notes"))


@register(
    "refresh_tables",
    """
    select o_orderkey, o_custkey, case when o_custkey % 10 = 1 then round(o_totalprice * 2, 2) else o_totalprice end as o_totalprice
    from orders where o_custkey % 10 <> 2
    """,
)
def refresh_tables(spark, d):
    """Orders as tables of their customer: one tenth of the customers changed, one tenth removed."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.filter(F.col("o_custkey") % 10 == 1).withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2))
    removed = load(spark, d, "customer").filter(F.col("c_custkey") % 10 == 2).select(F.col("c_custkey").alias("o_custkey"))
    return T.refresh_tables(o, new, removed, "o_custkey")


@register(
    "series_to_wide",
    """
    select year(l_shipdate)::int as category, round(sum(case when l_returnflag = 'A' then l_quantity end), 2) as "A",
      round(sum(case when l_returnflag = 'N' then l_quantity end), 2) as "N",
      round(sum(case when l_returnflag = 'R' then l_quantity end), 2) as "R" from lineitem group by 1
    """,
)
def series_to_wide(spark, d):
    points = load(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("category"), "l_returnflag").agg(
        F.round(F.sum("l_quantity"), 2).alias("q")
    )
    return T.series_to_wide(points, "category", "l_returnflag", "q", ["A", "N", "R"])


CHUNKS_SQL = f"""
    with recursive l as (select doc_id, unnest(string_split({SECTIONED_SQL}, chr(10))) as line,
                 generate_subscripts(string_split({SECTIONED_SQL}, chr(10)), 1) as ln from documents),
    f as (select *, regexp_matches(line, '^#{{1,6}}\\s+') as h, trim(line) = '' as blank from l),
    g as (select *, coalesce(lag(h or blank) over w, true) or h as opens from f window w as (partition by doc_id order by ln)),
    k as (select *, sum(case when opens and not blank then 1 else 0 end) over (partition by doc_id order by ln) as b from g),
    t as (select doc_id, b, min(ln) as lo, max(ln) as hi, bool_or(h) as h,
            trim(string_agg(line, chr(10) order by ln), ' ' || chr(10) || chr(9)) as body from k where not blank group by 1, 2),
    o as (select doc_id, b - 1 as seq, lo, hi, h, row_number() over (partition by doc_id order by b) as i,
            length(case when h then trim(regexp_replace(regexp_replace(body, '^#+\\s+', ''), '\\s*#*\\s*$', '')) else body end) as n from t where body <> ''),
    p(doc_id, i, seq, lo, hi, n, start, size) as (
      select doc_id, i, seq, lo, hi, n, i, n + 1 from o where i = 1
      union all select o.doc_id, o.i, o.seq, o.lo, o.hi, o.n, case when o.h or p.size + o.n > 1800 then o.i else p.start end, case when o.h or p.size + o.n > 1800 then 0 else p.size end + o.n + 1
      from p join o on o.doc_id = p.doc_id and o.i = p.i + 1),
    c as (select doc_id, min(seq)::bigint as first_seq, max(seq)::bigint as last_seq, case when min(lo) = max(hi) then 'L' || min(lo) else 'L' || min(lo) || '-L' || max(hi) end as anchor,
            (sum(n) + count(*) - 1)::int as n_chars from p group by doc_id, start)
"""


@register("make_chunks", CHUNKS_SQL + "select * from c")
def make_chunks(spark, d):
    docs = sectioned(spark, d)
    blocks = B.segment_text(docs)
    chunks = C.make_chunks(blocks)
    return chunks.select("doc_id", "first_seq", "last_seq", "anchor", F.length("text").alias("n_chars"))


@register(
    "assign_doc_ids",
    r"""
    with f as (select distinct regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/$', '.html') as path from pages),
    held as (select '4-' || n_nationkey as id from nation union select '144'),
    s as (select path, regexp_replace(regexp_extract(path, '[^/]+$'), '[.][^.]+$', '') as base, string_split(path, '/')[-2] as parent from f),
    r as (select *, row_number() over (partition by base order by path) + (base in (select id from held))::int as nth from s),
    taken as (select id from held union select base from r where nth = 1),
    w as (select *, base || '-' || parent as want, row_number() over (partition by base || '-' || parent order by path) as k from r where nth > 1),
    second as (select path, want as id from w where k = 1 and want not in (select id from taken)),
    left_over as (select path, base, row_number() over (partition by base order by path) as j from w where path not in (select path from second)),
    free as (select base, base || '-' || n as id, row_number() over (partition by base order by n) as j from (select distinct base from left_over), range(2, 400) t(n)
      where base || '-' || n not in (select id from taken union all select id from second))
    select path, base as doc_id from r where nth = 1 union all select path, id from second union all select path, id from left_over join free using (base, j)
    """,
)
def assign_doc_ids(spark, d):
    """Page addresses as file paths; ids of one host's pages are held already."""
    pages = load(spark, d, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    files = pages.select(F.regexp_replace(path, "/$", ".html").alias("path")).distinct()
    existing = load(spark, d, "nation").select(F.concat(F.lit("4-"), F.col("n_nationkey").cast("string")).alias("doc_id"))
    return C.assign_doc_ids(files, existing.unionByName(existing.select(F.lit("144").alias("doc_id")).distinct()))
