"""Sources: filters, decoding, segmentation, pages, grids and crawl planning over the given tables."""

import uuid

from pyspark.sql import functions as F

from attestra.operators.chunks import split_long
from attestra.plans.derived import PART_CELLS_SQL, SECTIONED_SQL, part_cells, sectioned
from attestra.plans.registry import register
from attestra.session import load, scratch_folder
from attestra.sources import blocks as B
from attestra.sources import delimited, grid, html, web

PATH_SQL = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def _paths(spark, d):
    pages = load(spark, d, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return pages.withColumn("path", path)


@register(
    "source_filter",
    f"""
    select page_id, path from (select page_id, {PATH_SQL} as path from pages)
    where lower(path) like '%.html' and not regexp_matches(path, '^m\\.[^/]*') and path not like 'www.%.example.net/de/%'
    """,
)
def source_filter(spark, d):
    kept = web.select_sources(_paths(spark, d), "path", [".html", ".htm"], ["m.*", "www.*.example.net/de/**"])
    return kept.select("page_id", "path")


@register(
    "head_filter",
    """
    select doc_id from (select doc_id, substr(hex(encode(text)), 1, 1200) as h from documents)
    where not (position(hex(encode('the ')) in h) > 0
      and (position(hex(encode('tion')) in h) > 0 or position(hex(encode('ing ')) in h) > 0))
    """,
)
def head_filter(spark, d):
    return web.drop_by_head(load(spark, d, "documents"), "text", "the ", ["tion", "ing "]).select("doc_id")


@register(
    "front_matter",
    "select doc_id, (case when doc_id % 3 = 0 then 0 else 5 end)::int as skip, case when doc_id % 3 = 0 then null else source end "
    "as source, case when doc_id % 3 = 0 then null else 'doc: ' || doc_id end as title from documents",
)
def front_matter(spark, d):
    """Front matter of rendered documents; in every third the block is never closed and counts as none."""
    docs = load(spark, d, "documents")
    close = F.when(F.col("doc_id") % 3 == 0, "-- -").otherwise("---")
    body = F.replace(F.col("text"), F.lit("---"), F.lit(""))
    text = F.concat_ws(
        "\n", F.lit("---"), F.lit("title: first"), F.concat(F.lit("source: "), "source"),
        F.concat(F.lit('title: "doc: '), F.col("doc_id").cast("string"), F.lit('"')), close, body,
    )
    fm = docs.select("doc_id", B.front_matter(text).alias("fm"))
    get = lambda k: F.try_element_at("fm.meta", F.lit(k)).alias(k)
    return fm.select("doc_id", F.col("fm.skip").alias("skip"), get("source"), get("title"))


@register(
    "segment_text",
    f"""
    with l as (select doc_id, unnest(string_split({SECTIONED_SQL}, chr(10))) as line,
                 generate_subscripts(string_split({SECTIONED_SQL}, chr(10)), 1) as ln from documents),
    f as (select *, regexp_matches(line, '^#{{1,6}}\\s+') as h, trim(line) = '' as blank from l),
    g as (select *, coalesce(lag(h or blank) over w, true) or h as opens from f window w as (partition by doc_id order by ln)),
    k as (select *, sum(case when opens and not blank then 1 else 0 end) over (partition by doc_id order by ln) as b from g),
    t as (select doc_id, b, min(ln) as lo, max(ln) as hi, bool_or(h) as h,
            trim(string_agg(line, chr(10) order by ln), ' ' || chr(10) || chr(9)) as body from k where not blank group by 1, 2)
    select doc_id, (b - 1)::int as seq, case when lo = hi then 'L' || lo else 'L' || lo || '-L' || hi end as anchor,
      case when h then 'heading' when regexp_matches(body, '^([-*+]|\\d+[.)])\\s') then 'list' else 'para' end as kind,
      md5(case when h then trim(regexp_replace(regexp_replace(body, '^#+\\s+', ''), '\\s*#*\\s*$', '')) else body end) as body
    from t where body <> ''
    """,
)
def segment_text(spark, d):
    blocks = B.segment_text(sectioned(spark, d))
    return blocks.select("doc_id", "seq", "anchor", "kind", F.md5("text").alias("body"))


@register(
    "pipe_tables",
    """
    with t as (select o_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice)
                 as n, * from lineitem join orders on l_orderkey = o_orderkey)
    select doc_id::varchar as doc_id, 'Table at line 3' as sheet, (n + 1)::int as r, 2 as c, l_extendedprice::varchar as v
      from t where doc_id in (select doc_id from t)
    union all select doc_id::varchar, 'Table at line 3', (n + 1)::int, 1, l_linenumber::varchar from t
    union all select distinct doc_id::varchar, 'Table at line 3', 1, 1, 'Line' from t
    union all select distinct doc_id::varchar, 'Table at line 3', 1, 2, 'Price' from t
    """,
)
def pipe_tables(spark, d):
    """Every order as a note with a pipe table of its lines (an order has a handful)."""
    items = load(spark, d, "lineitem")
    line = F.struct("l_linenumber", "l_partkey", "l_extendedprice")
    notes = items.groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(line)).alias("ls"))
    row = lambda x: F.concat(
        F.lit("| "), x["l_linenumber"].cast("string"), F.lit(" | "), x["l_extendedprice"].cast("string"), F.lit(" |")
    )
    text = F.concat(F.lit("# Order\n\n| Line | Price |\n|---|---:|\n"), F.array_join(F.transform("ls", row), "\n"))
    cells = B.pipe_table_cells(B.segment_text(notes.select("doc_id", text.alias("text"))))
    return cells.select("doc_id", "sheet", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v")


@register(
    "delimited_rows",
    """
    select 'c' || c_custkey // 50 as doc_id, (row_number() over (partition by c_custkey // 50 order by c_custkey) + 1)::int as r,
      'key: ' || c_custkey || ' | name: "' || c_name || '", the; | col3: ' || c_acctbal::varchar as body from customer
    union all select distinct 'c' || c_custkey // 50, 1, 'Columns: key, name, col3' from customer
    """,
)
def delimited_rows(spark, d):
    """Customers as files of 50 records; the delimiter differs by file, names hold it and quotes, blank lines are skipped."""
    return _row_blocks(delimited.read_delimited(_customer_files(spark, d)))


def _customer_files(spark, d):
    c = load(spark, d, "customer").withColumn("g", F.floor(F.col("c_custkey") / 50).cast("long"))
    sep = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t"), F.lit("|")), (F.col("g") % 4 + 1).cast("int"))
    name = F.concat(F.lit('"""'), "c_name", F.lit('"", the;"'))
    rec = F.concat(F.col("c_custkey").cast("string"), sep, name, sep, F.col("c_acctbal").cast("string"))
    recs = F.array_sort(F.collect_list(F.struct("c_custkey", rec.alias("rec"))))
    head = F.first(F.concat(F.lit("key"), sep, F.lit("name"), sep, F.lit("\n\n")))
    files = c.groupBy("g").agg(F.concat(head, F.array_join(F.transform(recs, lambda x: x["rec"]), "\r\n")).alias("text"))
    return files.select(F.concat(F.lit("c"), F.col("g").cast("string")).alias("doc_id"), "text")


def _row_blocks(rows):
    blocks = delimited.delimited_blocks(rows)
    return blocks.select("doc_id", (F.col("seq") + 1).cast("int").alias("r"), F.col("text").alias("body"))


@register(
    "delimited_files",
    """
    select 's' || s_nationkey as doc_id, (row_number() over (partition by s_nationkey order by s_suppkey) + 1)::int as r,
      'key: ' || s_suppkey || ' | note: "' || s_name || '";' || chr(10) || chr(10) || 'second, line | balance: ' || s_acctbal::varchar as body from supplier
    union all select distinct 's' || s_nationkey, 1, 'Columns: key, note, balance' from supplier
    """,
)
def delimited_files(spark, d):
    """Suppliers written as files, one per nation, with line breaks and quotes inside fields, and read in splits."""
    s = load(spark, d, "supplier")
    note = F.concat(F.lit('"""'), "s_name", F.lit('"";\r\n\nsecond, line"'))
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), note, F.col("s_acctbal").cast("string"))
    head = s.select("s_nationkey", F.lit(-1).cast("long").alias("k"), F.lit("key,note,balance\n").alias("value")).distinct()
    rows = head.unionByName(s.select("s_nationkey", F.col("s_suppkey").alias("k"), line.alias("value")))
    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    rows.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "k").select("value", "s_nationkey").write.partitionBy("s_nationkey").text(folder)
    found = delimited.read_delimited_files(spark, folder, "part-*")
    return _row_blocks(found.withColumn("doc_id", F.concat(F.lit("s"), F.regexp_extract("doc_id", r"s_nationkey=(\d+)/", 1))))


UNESC = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"


@register(
    "html_title",
    "select page_id, trim(regexp_replace("
    + UNESC.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
    + r", '\s+', ' ', 'g')) as title from pages",
)
def html_title(spark, d):
    return load(spark, d, "pages").select("page_id", html.html_title(F.col("html")).alias("title"))


def _main_sql() -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ["head", *html.DROPPED]:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    return f"regexp_replace({out}, '(?is)<div class=\"ad\">.*?</div>', ' ', 'g')"


def _block_sql() -> str:
    out = f"regexp_replace({_main_sql()}, '\\s+', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)<h([1-6])\\b[^>]*>', chr(1) || 'h\\1:', 'g')"
    out = f"regexp_replace({out}, '(?i)<li\\b[^>]*>', chr(1) || 'li:', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:{html.BLOCK_TAGS})\\b[^>]*>|</(?:h[1-6]|li|tr)>', chr(1) || 'pp:', 'g')"
    return f"regexp_replace({out}, '<[^>]*>', '', 'g')"


@register(
    "html_blocks",
    f"""
    with p as (select page_id, unnest(string_split({_block_sql()}, chr(1))) as part,
                 generate_subscripts(string_split({_block_sql()}, chr(1)), 1) as i from pages),
    q as (select page_id, i, regexp_extract(part, '^(h[1-6]|li|tr|pp):', 1) as tag,
            trim(regexp_replace({UNESC.format("regexp_replace(part, '^(?:h[1-6]|li|tr|pp):', '')")}, '\\s+', ' ', 'g')) as body from p)
    select page_id as doc_id, (i - 1)::int as seq, case when tag like 'h%' then 'heading' when tag = 'li' then 'list' else 'para' end as kind,
      md5(body) as body from q where body <> ''
    """,
)
def html_blocks(spark, d):
    blocks = html.html_blocks(load(spark, d, "pages"))
    return blocks.select("doc_id", "seq", "kind", F.md5("text").alias("body"))


@register(
    "page_links",
    r"""
    with h as (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"''#]+)', 1)) as href,
            generate_subscripts(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"''#]+)', 1), 1) as i from pages),
    u as (select page_id, i, url, case when regexp_matches(href, '^[a-zA-Z]+:') then href
            else regexp_extract(url, '^(https?://[^/?#]*)', 1) || href end as full_url from h),
    k as (select page_id, full_url, min(i) as i from u
            where regexp_extract(full_url, '^https?://([^/?#]*)', 1) = regexp_extract(url, '^https?://([^/?#]*)', 1) group by 1, 2)
    select page_id as doc_id, (row_number() over (partition by page_id order by i) - 1)::int as pos, full_url as url from k
    """,
)
def page_links(spark, d):
    return html.page_links(load(spark, d, "pages"))


@register(
    "section_path",
    """
    with l as (select doc_id, ln, case when ln % 7 = 1 then 1 when ln % 5 = 2 then 3 when ln % 3 = 0 then 2 end as level
               from (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as ln from documents)),
    p as (select *, max(case when level = 1 then ln end) over w as a, max(case when level = 2 then ln end) over w as b,
            max(case when level = 3 then ln end) over w as c from l
          window w as (partition by doc_id order by ln rows unbounded preceding))
    select doc_id, ln::int as ln, concat_ws(' > ', 'T' || a, case when b > coalesce(a, -1) then 'T' || b end,
      case when c > greatest(coalesce(a, -1), coalesce(b, -1)) then 'T' || c end) as section from p
    """,
)
def section_path(spark, d):
    """Lines of documents with headings of three levels assigned by line number."""
    docs = load(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("ln", F.col("i") + 1)
    level = F.when(F.col("ln") % 7 == 1, 1).when(F.col("ln") % 5 == 2, 3).when(F.col("ln") % 3 == 0, 2)
    titled = lines.select("doc_id", "ln", level.alias("level"), F.concat(F.lit("T"), F.col("ln").cast("string")).alias("title"))
    return B.with_sections(titled, "doc_id", "ln", "level", "title").select("doc_id", "ln", "section")


@register(
    "split_long",
    """
    with recursive s as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
    l as (select doc_id, generate_subscripts(ls, 1) as seq, length(unnest(ls)) as n from s where length(text) > 3000),
    p(doc_id, seq, start, size, n) as (
      select doc_id, seq, seq, n + 1, n from l where seq = 1
      union all select l.doc_id, l.seq, case when p.size + l.n > 1500 then l.seq else p.start end, case when p.size + l.n > 1500 then 0 else p.size end + l.n + 1, l.n
      from p join l on l.doc_id = p.doc_id and l.seq = p.seq + 1),
    g as (select doc_id, start, sum(n) + count(*) - 1 as n_chars from p group by 1, 2)
    select doc_id, (row_number() over (partition by doc_id order by start))::int as part, (count(*) over (partition by doc_id))::int as n_parts, n_chars::int as n_chars from g
    union all select doc_id, 1, 1, length(text)::int from documents where length(text) <= 3000
    """,
)
def split_long_pages(spark, d):
    parts = split_long(load(spark, d, "documents"), "doc_id", "text")
    return parts.select("doc_id", "part", "n_parts", F.length("text").alias("n_chars"))


@register("rejoin_wrapped", "select p_partkey, 'Status ' || p_name || ' of ' || p_brand || ' ' || p_type as cell from part")
def rejoin_wrapped(spark, d):
    part = load(spark, d, "part")
    text = F.concat(F.lit("Statu\ns "), "p_name", F.lit("\nof "), "p_brand", F.lit("\n"), "p_type", F.lit("\n"))
    return part.select("p_partkey", B.rejoin_wrapped(text).alias("cell"))


@register(
    "empty_units",
    """
    with b as (select source, doc_id, row_number() over (partition by source order by doc_id) as rn from documents where n_chars < 700)
    select source, count(*) as n_empty, string_agg(case when rn <= 20 then doc_id::varchar end, ', ' order by doc_id) as first
    from b group by 1
    """,
)
def empty_units(spark, d):
    """Documents as pages of their source; short ones count as pages without text."""
    docs = load(spark, d, "documents")
    pages = docs.select("source", "doc_id", F.when(F.col("n_chars") < 700, " \n").otherwise(F.col("text")).alias("text"))
    return B.empty_units(pages, "source", "doc_id", "text")


@register(
    "reading_order",
    """
    select l_orderkey as doc_id, 1 as slide, 'Order ' || l_orderkey || chr(10) || string_agg(repeat('  ', (l_linenumber % 3)::int) || '- part '
      || l_partkey, chr(10) order by l_suppkey, l_quantity, l_linenumber, l_partkey) as text from lineitem group by 1
    """,
)
def reading_order(spark, d):
    """An order as a slide: each line a shape placed by supplier and quantity."""
    items = load(spark, d, "lineitem")
    body = items.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("slide"), F.lit(False).alias("is_title"),
        F.col("l_suppkey").alias("top"), F.col("l_quantity").alias("left"), F.col("l_linenumber").alias("shape"),
        F.col("l_partkey").cast("int").alias("para"), (F.col("l_linenumber") % 3).alias("level"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"),
    )
    titles = items.select("l_orderkey").distinct().select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("slide"), F.lit(True).alias("is_title"),
        F.lit(0).cast("long").alias("top"), F.lit(0.0).alias("left"), F.lit(0).alias("shape"), F.lit(0).alias("para"),
        F.lit(0).alias("level"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("text"),
    )
    return B.reading_order(body.unionByName(titles)).select("doc_id", "slide", "text")


@register(
    "trim_grid",
    f"""
    select doc_id, sheet, count(*) as n_cells, max(r)::int as n_rows, max(c)::int as n_cols from {PART_CELLS_SQL} x
    where r <= 404 and c <= 7 and r <= (select max(r) from {PART_CELLS_SQL} y where y.sheet = x.sheet and trim(coalesce(v, '')) <> '')
    group by 1, 2
    """,
)
def trim_grid(spark, d):
    inside = grid.trim_grid(part_cells(spark, d))
    return inside.groupBy("doc_id", "sheet").agg(
        F.count("*").alias("n_cells"), F.max("r").alias("n_rows"), F.max("c").alias("n_cols")
    )


@register("detect_header", f"select distinct doc_id, sheet, 4::bigint as header_row from {PART_CELLS_SQL}")
def detect_header(spark, d):
    return grid.detect_header(part_cells(spark, d))


@register(
    "row_text",
    f"""
    with x as (select * from {PART_CELLS_SQL} where trim(coalesce(v, '')) <> ''),
    h as (select doc_id, sheet, c, v as name from x where r = 4),
    e as (select doc_id, sheet, max(r) as n_rows, count_if(r > 4 and c = 2) as n_data from x group by 1, 2),
    q as (select doc_id, sheet, case when regexp_matches(sheet, '^[A-Za-z0-9_.]+$') then sheet else '''' || sheet || '''' end as ref,
            n_rows, n_data from e),
    b as (select x.doc_id, x.sheet, x.r::bigint as r, string_agg(name || ': ' || trim(v), ' | ' order by x.c) as text
          from x join h using (doc_id, sheet, c) where x.r > 4 group by all),
    g as (select doc_id, sheet, count(*) as n_gaps from {PART_CELLS_SQL} where v is null and formula like '=%' group by 1, 2)
    select doc_id, sheet, r, ref || '!B' || r || ':G' || r as anchor, 'row' as kind, text from b join q using (doc_id, sheet)
    union all select doc_id, sheet, r::bigint, ref || '!A' || r || ':G' || r, 'row', v from x join q using (doc_id, sheet) where r < 4
    union all select doc_id, sheet, 0, ref || '!A1:G' || n_rows, 'sheet', sheet || ' has ' || n_data ||
      ' rows of data in 6 columns, header in row 4: Part key, Name, Brand, Size, Retail price, Note.' ||
      case when n_gaps is null then '' else ' Not calculated yet: ' || n_gaps || ' formulas without a stored value.' end
      from q left join g using (doc_id, sheet)
    """,
)
def row_text(spark, d):
    cells = part_cells(spark, d)
    return grid.sheet_blocks(cells, grid.detect_header(cells))


@register(
    "formula_gaps",
    f"select doc_id, sheet, count(*) as n_gaps from {PART_CELLS_SQL} where v is null and formula like '=%' group by 1, 2",
)
def formula_gaps(spark, d):
    return grid.formula_gaps(part_cells(spark, d))


HOST_SQL = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@register(
    "plan_frontier",
    r"""
    with seeds as (select url, min(page_id) as pos from pages group by 1),
    h as (select page_id, url as base, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"''#]+)', 1)) as href,
            generate_subscripts(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"''#]+)', 1), 1) as i from pages),
    u as (select page_id, i, base, case when regexp_matches(href, '^[a-zA-Z]+:') then href
            else regexp_extract(base, '^(https?://[^/?#]*)', 1) || href end as url from h),
    k as (select page_id, url, min(i) as i from u
            where regexp_extract(url, '^https?://([^/?#]*)', 1) = regexp_extract(base, '^https?://([^/?#]*)', 1) group by 1, 2),
    l as (select page_id, url, row_number() over (partition by page_id order by i) - 1 as link_pos from k),
    f as (select l.* from l join (select pos from seeds) p on l.page_id = p.pos left join seeds s using (url)
            where s.pos is null or s.pos > l.page_id order by page_id, link_pos, url limit 500),
    o as (select url, min({'a': page_id, 'b': link_pos}) as spot from f group by 1)
    select url, 0 as depth, pos::bigint as pos, -1 as link_pos from seeds
    union all select url, 1, spot.a::bigint, spot.b::int from o where url not in (select url from seeds)
    """,
)
def plan_frontier(spark, d):
    pages = load(spark, d, "pages")
    links = html.page_links(pages).select(F.col("doc_id").alias("from_pos"), F.col("pos").alias("link_pos"), "url")
    return web.plan_frontier(pages.select(F.col("page_id").alias("pos"), "url"), links, 500)


@register(
    "robots_filter",
    f"""
    with u as (select page_id, url, {HOST_SQL} as host, regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '#.*$', '') as path from pages)
    select page_id, url, case when host like 'm.%' then true
      when path like '/en/%' and host like 'blog.%' then true when path like '/en/%' then false
      when path like '/de/1%' then false else true end as allowed from u
    """,
)
def robots_filter(spark, d):
    """Rules per host as robots files would give them; mobile hosts have none."""
    pages = load(spark, d, "pages").select("page_id", "url")
    hosts = pages.select(html.host(F.col("url")).alias("host")).distinct().filter("host not like 'm.%'")
    blog = F.col("host").startswith("blog.")
    rule = lambda o, p, a: F.struct(F.lit(o).alias("ord"), F.lit(p).alias("path_prefix"), a.alias("allow"))
    rules = hosts.select(
        "host", F.explode(F.array(rule(1, "/en/", blog), rule(2, "/en", F.lit(True)), rule(3, "/de/1", F.lit(False)))).alias("x")
    ).select("host", "x.*")
    return web.robots_filter(pages, rules).select("page_id", "url", "allowed")


SITE = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
PLACE = "regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '#.*$', ''), '\\?.*$', '')"
STEM = (
    f"rtrim(substr(trim(regexp_replace(lower({SITE} || '-' || {PLACE}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 70), '-')"
)


@register(
    "route_content",
    f"""
    with r as (select page_id, url, {STEM} as stem, case page_id % 4 when 0 then '.pdf' when 1 then '.csv' else '.md' end as suffix,
                 sha256(html) as digest from (select page_id, replace(url, 'www.', '') as url, html from pages))
    select page_id, suffix, digest, stem || case when row_number() over w > 1 then '-' || row_number() over w else '' end || suffix as name
    from r window w as (partition by stem, suffix order by page_id)
    """,
)
def route_content(spark, d):
    pages = load(spark, d, "pages")
    kind = F.element_at(
        F.array(F.lit("application/pdf"), F.lit("TEXT/CSV ; charset=utf-8"), F.lit("text/html"), F.lit("")),
        (F.col("page_id") % 4 + 1).cast("int"),
    )
    fetched = pages.select(
        "page_id", F.replace(F.col("url"), F.lit("www."), F.lit("")).alias("url"), kind.alias("content_type"), F.col("html").alias("body")
    )
    return web.route_content(fetched, "page_id").select("page_id", "suffix", "digest", "name")
