"""Drafts derived from parts, their evidence, and the checks on them.

Part k is paragraph k % 10 of draft k // 10 and one row block of document ``parts-{k // 100}``; what is
right or wrong with its paragraph follows from k % 12, so the expected outcome is plain SQL.
"""


from pyspark.sql import functions as F

from attestra.functions.text import norm_quote
from attestra.operators import citations as C
from attestra.operators import evidence as E
from attestra.operators import results as R
from attestra.operators import verify as V
from attestra.plans.registry import register
from attestra.plans.text_functions import WS
from attestra.scale import pinned
from attestra.session import durable, load


def _k():
    return F.col("p_partkey")


def _s(c):
    return c.cast("string")


def _price(c):
    return F.format_number(c, 2)


def _doc():
    return F.concat(F.lit("parts-"), _s(F.floor(_k() / 100)))


def _ref():
    return F.concat(_doc(), F.lit("#R"), _s(_k() % 100 + 1))


def part_blocks(spark, d):
    text = F.concat(
        F.lit("key: "), _s(_k()), F.lit(" | name: "), "p_name", F.lit(" | brand: "), "p_brand", F.lit(" | size: "), _s(F.col("p_size")),
        F.lit(" | price: "), _s(F.col("p_retailprice")),
    )
    return load(spark, d, "part", spread=True).select(
        _doc().alias("doc_id"), (_k() % 100).alias("seq"), F.concat(F.lit("R"), _s(_k() % 100 + 1)).alias("anchor"), F.lit("row").alias("kind"),
        F.lit("").alias("section"), text.alias("text"),
    )


def part_docs(spark, d):
    docs = load(spark, d, "part", spread=True).select(_doc().alias("doc_id")).distinct()
    return docs.select("doc_id", F.concat(F.lit("lists/2024-03-05 "), "doc_id", F.lit(".csv")).alias("path"), F.lit("Part list").alias("title"), F.lit("csv").alias("doc_type"))


def brand_results(spark, d):
    """Average price per brand as saved results numbered by the brand's number."""
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    per = load(spark, d, "part", spread=True).groupBy(number.alias("result_id"), "p_brand").agg(F.avg("p_retailprice").alias("avg_price"))
    rows = per.select("result_id", F.lit(1).alias("row_no"), F.to_json(F.struct("p_brand", "avg_price")).alias("row_json"))
    heads = per.select(
        "result_id",
        F.concat(F.lit("select p_brand, avg(p_retailprice) from part where p_brand = '"), "p_brand", F.lit("' group by 1")).alias("sql"),
        F.array(F.lit("p_brand"), F.lit("avg_price")).alias("columns"),
        F.array(F.lit("data/part.parquet")).alias("source_files"),
    )
    return heads, rows


def part_drafts(spark, d):
    part = load(spark, d, "part", spread=True)
    avg = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("avg_price"))
    p = part.join(avg, "p_brand")
    cc = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    price, name = _price(F.col("p_retailprice")), F.col("p_name")
    lines = [
        cc("The ", name, " costs $", price, " [@", _ref(), "]."),
        cc("The ", name, " costs $", _price(F.col("p_retailprice") + 500), " [@", _ref(), "]."),
        cc("The ", name, " costs $", price, " each."),
        cc("It is listed as such [@", _ref(), ' "name: golden ', name, '"].'),
        cc("The price is $", price, " [@nope-1#R1]."),
        cc("The price is $", price, " [@", _doc(), "#R9999]."),
        cc("Assumption: the price falls to $1 soon."),
        cc("The price doubles to $", _price(F.col("p_retailprice") * 2), " (derived) [@", _ref(), "]."),
        cc("See [@", _ref(), " oops] for the price list of this part."),
        cc("The average price of ", F.col("p_brand"), " is $", _price(F.round("avg_price", 2)), " [@calc:", F.regexp_extract("p_brand", r"(\d+)$", 1), "]."),
        cc("The ", name, " costs $", price, " [@", _ref(), ' "NAME: ', name, ' … price"; @', _ref(), "]."),
        cc("On 5 March 2024 prices reached $", price, " [@", _doc(), "]."),
    ]
    line = lines[-1]
    for i in range(11):
        line = F.when(_k() % 12 == i, lines[i]).otherwise(line)
    # a draft has ten paragraphs
    paras = p.groupBy(F.floor(_k() / 10).alias("draft_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n\n")
    text = cc("---\ntitle: draft\n---\n# Parts ", _s(F.col("draft_id")), "\n\n", body, "\n\n## Sources\n- Price list 2023, p. 12\n")
    return paras.select("draft_id", text.alias("text"))


def _inputs(spark, d):
    heads, rows = brand_results(spark, d)
    return part_drafts(spark, d), part_docs(spark, d), part_blocks(spark, d), heads, rows


def checked(spark, d):
    return V.verify(*_inputs(spark, d))


V_SQL = "with p as (select p_partkey // 10 as draft_id, p_partkey % 12 as v, p_partkey % 10 as n, p_partkey as k, * from part), "


@register(
    "parse_citations",
    V_SQL + """c as (select draft_id, k, v, unnest(case when v = 10 then [1, 2] else [1] end) as i from p where v not in (2, 6)),
    r as (select draft_id, k, v, i, case when v = 4 then 'nope-1#R1' when v = 5 then 'parts-' || k // 100 || '#R9999' when v = 11 then 'parts-' || k // 100
        when v = 9 then 'calc:' || regexp_extract((select p_brand from part where p_partkey = k), '(\\d+)$', 1) else 'parts-' || k // 100 || '#R' || (k % 100 + 1) end as ref,
      case when v = 3 then 'name: golden ' || (select p_name from part where p_partkey = k)
        when v = 10 and i = 1 then 'NAME: ' || (select p_name from part where p_partkey = k) || ' … price' end as quote from c)
    select draft_id, (row_number() over (partition by draft_id order by k, i) - 1)::int as pos, case when v <> 8 then ref end as ref, quote,
      case when i = 2 then '@' else '' end || ref || case when quote is not null then ' "' || quote || '"' when v = 8 then ' oops' else '' end as item, v <> 8 as ok from r
    """,
)
def parse_citations(spark, d):
    rows = part_drafts(spark, d).select("draft_id", F.posexplode(C.parse_citations(F.col("text"))).alias("pos", "c"))
    return rows.select("draft_id", "pos", "c.ref", "c.quote", "c.item", "c.ok")


@register(
    "citation_items",
    V_SQL + """c as (select draft_id, k, v, unnest(case when v = 10 then [1, 2] else [1] end) as i from p where v not in (2, 6))
    select draft_id, case when v = 8 then null when v = 4 then 'nope-1#R1' when v = 5 then 'parts-' || k // 100 || '#R9999' when v = 11 then 'parts-' || k // 100
        when v = 9 then 'calc:' || regexp_extract((select p_brand from part where p_partkey = k), '(\\d+)$', 1) else 'parts-' || k // 100 || '#R' || (k % 100 + 1) end as ref,
      case when v = 3 then 'name: golden ' || (select p_name from part where p_partkey = k)
        when v = 10 and i = 1 then 'NAME: ' || (select p_name from part where p_partkey = k) || ' … price' end as quote, v <> 8 as ok from c
    """,
)
def citation_items(spark, d):
    return parse_citations(spark, d).select("draft_id", "ref", "quote", "ok")


@register(
    "strip_citations",
    "select c_custkey, 'Customer ' || c_name || ' owes  and is in segment ' || c_mktsegment || '.' as text from customer",
)
def strip_citations(spark, d):
    text = F.concat(
        F.lit("Customer "), "c_name", F.lit(" owes [@calc:1] and is in segment "), "c_mktsegment", F.lit('[@a#p1 "x"; @b].')
    )
    return load(spark, d, "customer").select("c_custkey", C.strip_citations(text).alias("text"))


@register(
    "split_units",
    V_SQL + "f as (select draft_id, min(k) as k0 from p group by 1) select draft_id, (6 + 2 * (k - k0))::int as line, v = 6 as exempt from p join f using (draft_id)",
)
def split_units(spark, d):
    units = V.split_units(part_drafts(spark, d))
    return units.select("draft_id", F.col("line").cast("int").alias("line"), V.is_exempt(F.col("text")).alias("exempt"))


@register(
    "exempt_units",
    "select conv_id, turn, turn % 4 <> 3 as exempt from conversations",
)
def exempt_units(spark, d):
    head = F.element_at(
        F.array(F.lit("- **Hypothesis: "), F.lit("2) Open questions "), F.lit("(Judgement) "), F.lit("Ideally ")), (F.col("turn") % 4 + 1).cast("int")
    )
    rows = load(spark, d, "conversations").withColumn("t", F.concat(head, "text"))
    return rows.select("conv_id", "turn", V.is_exempt(F.col("t")).alias("exempt"))


@register(
    "split_sentences",
    r"""
    select doc_id, case when starts_with(text, '|') then 1 else len(list_filter(string_split(
      regexp_replace(text, '([.!?])[\s\x0b\x1c-\x1f\x85\pZ]+(["“(\[A-Z0-9À-Ỹ*_])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13)) <> ''))::int end as n_sentences from documents
    """,
)
def split_sentences(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.size(C.split_sentences(F.col("text"))).alias("n_sentences"))


@register(
    "borrow_citations",
    """
    with l as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as n, l_linenumber % 3 = 0 as has,
            l_partkey as p from lineitem)
    select o as order_id, (n - 1)::int as n, coalesce(case when has then p end,
      first_value(case when has then p end ignore nulls) over (partition by o order by n rows between 1 following and unbounded following),
      last_value(case when has then p end ignore nulls) over (partition by o order by n rows between unbounded preceding and 1 preceding)) as part from l
    """,
)
def borrow_citations(spark, d):
    """The lines of an order as the sentences of a paragraph; every third carries a citation."""
    items = load(spark, d, "lineitem")
    cite = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" [@part-"), _s(F.col("l_partkey")), F.lit("#L1]"))).otherwise("")
    line = F.struct("l_linenumber", "l_partkey", "l_extendedprice", F.concat(F.lit("Line"), cite, F.lit(".")).alias("t"))
    paras = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["t"]), " ")
    units = V.described_units(paras.select(F.col("l_orderkey").alias("draft_id"), F.lit(1).alias("line"), text.alias("text"), F.lit(False).alias("table_exempt")))
    rows = units.select(F.col("draft_id").alias("order_id"), F.posexplode("borrowed").alias("n", "c"))
    ref = F.get("c", F.lit(0))["ref"]
    return rows.select("order_id", "n", F.regexp_extract(ref, r"^part-(\d+)#", 1).cast("bigint").alias("part"))


@register(
    "evidence",
    """
    with p as (select p_partkey as k, p_partkey // 100 as g, regexp_extract(p_brand, '(\\d+)$', 1) as b, p_brand,
      'key: ' || p_partkey || ' | name: ' || p_name || ' | brand: ' || p_brand || ' | size: ' || p_size || ' | price: ' || p_retailprice as t from part)
    select 'parts-' || g || '#R' || (k % 100 + 1) as ref, 1::bigint as n_blocks, true as dated, 'none' as error, 0::bigint as pos, md5(t) as body from p
    union all select 'parts-' || g, count(*) over (partition by g), true, 'none', row_number() over (partition by g order by k) - 1, md5(t) from p
    union all select distinct 'calc:' || b, 0, false, 'none', 0, md5('select p_brand, avg(p_retailprice) from part where p_brand = ''' || p_brand || ''' group by 1') from p
    union all select distinct 'calc:' || b, 0, false, 'none', 1, md5('p_brand avg_price') from p
    union all select distinct 'calc:' || b, 0, false, 'none', 2, md5('| ' || p_brand) from p
    union all select 'parts-' || g || '#R101', 0, true, 'Anchor ''R101'' not found in parts-' || g, null, null from p group by g
    """,
)
def evidence(spark, d):
    """Every piece of every reference, and whether the day in the document's name is among its values."""
    _, docs, blocks, heads, rows = _inputs(spark, d)
    calc = F.concat(F.lit("calc:"), F.regexp_extract("p_brand", r"(\d+)$", 1))
    asked = F.array(_ref(), _doc(), calc, F.concat(_doc(), F.lit("#R101")))
    refs = load(spark, d, "part", spread=True).select(F.explode(asked).alias("ref"))
    ev = E.evidence(refs, docs, blocks, heads, rows)
    dated = ev.values.groupBy("ref").agg(F.bool_or(F.col("value") == 20240305.0).alias("dated"))
    told = ev.refs.join(dated, "ref", "left").join(ev.pieces, "ref", "left")
    return told.select("ref", "n_blocks", F.coalesce("dated", F.lit(False)).alias("dated"), F.coalesce("error", F.lit("none")).alias("error"), "pos", F.md5("text").alias("body"))


@register(
    "quote_check",
    f"""
    with t as (select doc_id, lower(trim(regexp_replace(translate(text, '’‘“”–—' || chr(160), '''''""-- '), '{WS}', ' ', 'g'))) as t from documents),
    w as (select doc_id, t, string_split(t, ' ') as w from t where t <> ''),
    n as (select *, greatest(len(w) // 3, 1) as a, greatest(2 * len(w) // 3, 1) as b from w),
    q as (select *, array_to_string(w[a : a + 5], ' ') as x, array_to_string(w[b : b + 3], ' ') as y from n),
    k as (
      select doc_id, t, 0 as kind, [x] as parts from q
      union all select doc_id, t, 1, [x, y] from q union all select doc_id, t, 2, [y, x] from q
      union all select doc_id, t, 3, [x || ' qqzzqq'] from q
      union all select doc_id, t, 4, [substring(t, length(t) // 4 + 1, 12), substring(t, length(t) // 2 + 1, 2)] from q
    ), p as (select doc_id, kind, t, list_filter(list_transform(parts, lambda p: trim(p, ' .,;:')), lambda p: p <> '') as p from k),
    f as (select *, case when len(p) = 0 then 1 else strpos(t, p[1]) end as first from p)
    select doc_id, kind, first > 0 and (len(p) < 2 or strpos(substring(t, first + length(p[1])), p[2]) > 0) as found from f
    """,
)
def quote_check(spark, d):
    """Quotes from a third and two thirds of each document, against its lines as pieces: over line ends, with a gap, in
    the wrong order, with a word too many, and cut inside words."""
    docs = load(spark, d, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: norm_quote(x) != "")
    pieces = docs.select(F.col("doc_id").cast("string").alias("ref"), F.posexplode(lines).alias("pos", "text"))
    pieces = pieces.withColumn("pos", F.col("pos").cast("long"))
    rows = pinned(docs.select("doc_id", norm_quote(F.col("text")).alias("t")).filter("t <> ''"), "w", F.split("t", " "))
    n = F.size("w")
    words = lambda at, k: F.array_join(F.slice("w", F.greatest((n * at / 3).cast("int"), F.lit(1)), F.lit(k)), " ")
    piece = lambda at, k: F.substring("t", (F.length("t") / at).cast("int") + 1, F.lit(k))
    x, y = words(1, 6), words(2, 4)
    made = [x, F.concat(x, F.lit(" … "), y), F.concat(y, F.lit("..."), x), F.concat(x, F.lit(" qqzzqq")), F.concat(piece(4, 12), F.lit(" [...] "), piece(2, 2))]
    quoted = durable(rows.select(F.col("doc_id").cast("string").alias("ref"), F.posexplode(F.array(*made)).alias("kind", "quote")))
    found = E.quotes_found(quoted, pieces)
    return quoted.join(found, ["ref", "quote"]).select(F.col("ref").cast("long").alias("doc_id"), "kind", "found")


@register(
    "check_figures",
    V_SQL + "c as (select draft_id, case when v = 11 then 2 else 1 end as figures, v from p where v in (0, 1, 9, 10, 11)) "
    "select draft_id, sum(figures)::bigint as n, sum(case when v = 1 then 0 else figures end)::bigint as n_ok from c group by 1",
)
def check_figures(spark, d):
    figures = checked(spark, d).figures
    return figures.groupBy("draft_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


CODES = "case v when 1 then 'figure-mismatch' when 2 then 'uncited-figure' when 3 then 'bad-quote' when 4 then 'unknown-ref' when 5 then 'unknown-ref' when 7 then 'derived' when 8 then 'malformed' when 11 then 'broad-ref' end"


@register(
    "issue_counts",
    V_SQL + f"i as (select draft_id, {CODES} as code, v from p) select draft_id, code, case code when 'derived' then 'info' when 'broad-ref' then 'warn' else 'error' end as level, "
    "count(*) as n from i where code is not null group by all",
)
def issue_counts(spark, d):
    return checked(spark, d).issues().groupBy("draft_id", "code", "level").agg(F.count("*").alias("n"))


@register(
    "verify_report",
    V_SQL + """r as (select draft_id, count(*) as units, count_if(v = 6)::bigint as units_exempt, count_if(v not in (2, 6, 8))::bigint as units_cited,
        sum(case when v = 10 then 2 when v in (2, 6, 8) then 0 else 1 end)::bigint as citations,
        sum(case when v = 10 then 2 when v in (0, 1, 7, 9, 11) then 1 else 0 end)::bigint as citations_ok,
        sum(case when v = 11 then 2 when v in (0, 1, 9, 10) then 1 else 0 end)::bigint as figures_checked,
        sum(case when v = 11 then 2 when v in (0, 9, 10) then 1 else 0 end)::bigint as figures_ok,
        count_if(v in (1, 2, 3, 4, 5, 8))::bigint as errors, count_if(v = 11)::bigint as warnings from p group by 1)
    select *, case when errors > 0 then 'FAIL' when warnings > 0 then 'WARN' else 'PASS' end as status from r
    """,
)
def verify_report(spark, d):
    return checked(spark, d).report()


@register(
    "gate",
    V_SQL + "r as (select draft_id, count_if(v in (1, 2, 3, 4, 5, 8)) as e from p group by 1) select draft_id, case when e > 0 then 'UNVERIFIED' end as stamp from r",
)
def gate(spark, d):
    result = checked(spark, d)
    return R.gate(result.drafts.select("draft_id"), result.report(), force=True).select("draft_id", "stamp")


@register(
    "claim_pairs",
    V_SQL + "c as (select draft_id, k, v, unnest(case when v = 10 then [1, 2] else [1] end) as i from p where v not in (2, 6, 8)) "
    "select draft_id, count(*) as n_pairs, count_if(v in (4, 5))::bigint as n_unresolved from c group by 1",
)
def claim_pairs(spark, d):
    pairs = checked(spark, d).claim_pairs()
    return pairs.groupBy("draft_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("evidence") == "(unresolved)").alias("n_unresolved"))


@register(
    "number_sources",
    V_SQL
    + """f as (select draft_id, k, v, 'parts-' || k // 100 as doc, regexp_extract(p_brand, '(\\d+)$', 1) as b, p_brand from p where v not in (2, 6, 8)),
    r as (select draft_id, min(k) as k, case when v = 4 then 'nope-1#R1' when v = 5 then doc || '#R9999' when v = 11 then doc when v = 9 then 'calc:' || b
          else doc || '#R' || (k % 100 + 1) end as ref, any_value(doc) as doc, any_value(p_brand) as p_brand from f group by 1, 3)
    select draft_id, (row_number() over (partition by draft_id order by k))::int as number, ref,
      case when ref like 'calc:%' then 'Calculation ' || ref || ' over data/part.parquet. SQL: select p_brand, avg(p_retailprice) from part where p_brand = ''' || p_brand
          || ''' group by 1' when ref like 'nope%' then ref || ' (unresolved)'
        else 'Part list — lists/2024-03-05 ' || doc || '.csv' || case when contains(ref, '#') then ', ' || split_part(ref, '#', 2) else '' end end as entry from r
    """,
)
def number_sources(spark, d):
    _, docs, _, heads, _ = _inputs(spark, d)
    cites = parse_citations(spark, d).filter("ok").select("draft_id", "pos", "ref")
    return R.number_sources(cites, docs, heads)


@register(
    "table_citations",
    """
    with p as (select p_partkey // 10 as draft_id, p_partkey as k from part)
    select draft_id, (case when draft_id % 3 < 2 then count(*) else 0 end)::bigint as n, (case when draft_id % 3 < 2 then count_if(k % 4 <> 0) else 0 end)::bigint as n_ok,
      (case when draft_id % 3 = 2 then count(*) else 0 end)::bigint as n_uncited
    from p group by draft_id
    """,
)
def table_citations(spark, d):
    """Drafts whose figures stand in a table that is cited in the caption above it, in its header, or nowhere; every fourth price is wrong."""
    cc = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    draft = F.floor(_k() / 10)
    price = _price(F.col("p_retailprice") + F.when(_k() % 4 == 0, 50000).otherwise(0))
    rows = load(spark, d, "part", spread=True).groupBy(draft.alias("draft_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", cc("| ", F.col("p_name"), " | $", price, " |").alias("row")))).alias("rs"))
    kind, cite = F.col("draft_id") % 3, cc(" [@parts-", _s(F.floor(F.col("draft_id") / 10)), "]")
    caption = cc("### Prices", F.when(kind == 0, cite).otherwise(""))
    header = cc("| Part | Price", F.when(kind == 1, cite).otherwise(""), " |\n|---|---|\n")
    drafts = rows.select("draft_id", cc("# List\n\n", caption, "\n\n", header, F.array_join(F.transform("rs", lambda r: r["row"]), "\n")).alias("text"))
    result = V.verify(drafts, part_docs(spark, d), part_blocks(spark, d), *brand_results(spark, d))
    figures = result.figures.groupBy("draft_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))
    bare = result.issues().filter("code = 'uncited-figure'").groupBy("draft_id").agg(F.count("*").alias("n_uncited"))
    return result.drafts.select("draft_id").join(figures.hint("merge"), "draft_id", "left").join(bare.hint("merge"), "draft_id", "left").fillna(0)
