"""Column functions run over whole tables."""

from pyspark.sql import functions as F

from attestra.functions import anchors as A
from attestra.functions import numbers as N
from attestra.functions import text as X
from attestra.plans.registry import register
from attestra.session import load

FIRST_LINE = "split_part(text, chr(10), 1)"
ASCII = "regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')"
SLUG = (
    "rtrim(substr(trim(regexp_replace(lower(" + ASCII + "), '[^a-z0-9]+', '{1}', 'g'), '{1}'), 1, {2}), '{1}')"
)


def slug_sql(expr: str, sep: str = "-", n: int = 48) -> str:
    body = SLUG.format(expr, sep, n)
    return f"(case when {body} = '' then 'x' else {body} end)"


def ident_sql(expr: str) -> str:
    body = slug_sql(expr, "_", 60)
    return f"(case when regexp_matches({body}, '^[0-9]') then 'c_' || {body} else {body} end)"


@register("slugify", f"select doc_id, {slug_sql(FIRST_LINE)} as slug from documents")
def slugify(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", X.slugify(F.split("text", "\n")[0]).alias("slug"))


@register("sql_ident", f"select p_partkey, {ident_sql('p_size || p_name')} as ident, "
          f"{ident_sql('p_brand')} as brand_ident from part")
def sql_ident(spark, d):
    part = load(spark, d, "part", spread=True)
    sized = F.concat(F.col("p_size").cast("string"), "p_name")
    return part.select("p_partkey", X.sql_ident(sized).alias("ident"), X.sql_ident(F.col("p_brand")).alias("brand_ident"))


@register("fold", "select doc_id, md5(lower(strip_accents(text))) as folded from documents")
def fold(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@register(
    "decode_text",
    r"select doc_id, md5(case when doc_id % 2 = 0 then text else regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') end)"
    " as decoded from documents",
)
def decode_text(spark, d):
    docs = load(spark, d, "documents")
    utf8 = F.concat(F.lit("﻿"), "text").cast("binary")
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    raw = F.when(F.col("doc_id") % 2 == 0, utf8).otherwise(latin)
    return docs.select("doc_id", raw.alias("raw")).select("doc_id", F.md5(X.decode_text(F.col("raw"))).alias("decoded"))


@register(
    "truncate_text",
    """
    with h as (select doc_id, text, substr(text, 1, 400) as head from documents),
    p as (select *, length(head) - strpos(reverse(head), chr(10)) + 1 as pos,
                 strpos(head, chr(10)) > 0 as has from h)
    select doc_id, length(text) > 400 as cut,
           md5(case when length(text) <= 400 then text when has and pos - 1 >= 240 then substr(head, 1, pos - 1)
                    else head end) as kept
    from p
    """,
)
def truncate_text(spark, d):
    docs = load(spark, d, "documents").select("doc_id", X.truncate_text(F.col("text"), 400).alias("t"))
    return docs.select("doc_id", F.col("t.cut").alias("cut"), F.md5(F.col("t.text")).alias("kept"))


WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0B]+"
FLAT = f"trim(regexp_replace(text, '{WS}', ' ', 'g'))"


@register(
    "lead_text",
    f"select doc_id, substr({FLAT}, 1, 220) || case when length({FLAT}) > 220 then ' …' else '' end as lead_text "
    "from documents",
)
def lead_text(spark, d):
    return load(spark, d, "documents").select("doc_id", X.lead_text(F.col("text")).alias("lead_text"))


@register(
    "norm_quote",
    "select doc_id, md5(lower(trim(regexp_replace(translate(text, '’‘“”–—' || chr(160), "
    f"'''''\"\"-- '), '{WS}', ' ', 'g')))) as normed from documents",
)
def norm_quote(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(X.norm_quote(F.col("text"))).alias("normed"))


@register("content_hash", "select doc_id, sha256(text) as digest from documents")
def content_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("digest"))


@register(
    "format_value",
    """
    select shown_price, shown_discount, shown_date, count(*) as n from (
      select case when l_extendedprice = floor(l_extendedprice) then cast(cast(l_extendedprice as bigint) as varchar)
                  else cast(l_extendedprice as varchar) end as shown_price,
             case when l_discount * 100 = floor(l_discount * 100) then cast(cast(l_discount * 100 as bigint) as varchar)
                  else cast(round(l_discount * 100, 10) as varchar) end || '%' as shown_discount,
             strftime(l_shipdate, '%Y-%m-%d') as shown_date from lineitem)
    group by all
    """,
)
def format_value(spark, d):
    items = load(spark, d, "lineitem", spread=True)
    shown = items.select(
        N.format_value(F.col("l_extendedprice"), "double").alias("shown_price"),
        N.format_value(F.col("l_discount"), "double", F.lit("0%")).alias("shown_discount"),
        N.format_value(F.col("l_shipdate"), "timestamp").alias("shown_date"),
    )
    return shown.groupBy("shown_price", "shown_discount", "shown_date").agg(F.count("*").alias("n"))


@register(
    "display_number",
    r"""
    select p_partkey,
      case when p_retailprice = floor(p_retailprice) then cast(cast(p_retailprice as bigint) as varchar)
           else regexp_replace(format('{:.4f}', p_retailprice), '\.?0+$', '') end as price,
      case when p_size / p_retailprice = 0 then '0' when p_size / p_retailprice >= 1 then 'big'
           else format('{:.6g}', p_size / p_retailprice) end as share
    from part
    """,
)
def display_number(spark, d):
    part = load(spark, d, "part", spread=True)
    share = F.col("p_size") / F.col("p_retailprice")
    return part.select(
        "p_partkey", N.display_number(F.col("p_retailprice")).alias("price"), N.display_number(share).alias("share")
    )


def _grouped(c):
    """Number with thousands commas and two decimals."""
    return F.format_number(c, 2)


@register(
    "find_numbers",
    """
    select o_orderkey, 4::bigint as n_figures, 1::bigint as n_approx, 1::bigint as n_percent,
      round(o_totalprice + o_custkey + floor(o_totalprice / 1000) * 1000 + (o_orderkey % 90 + 10) / 10.0, 2) as total
    from orders
    """,
)
def find_numbers(spark, d):
    """Order lines rendered as prose; codes glued to words must not count, the k suffix marks a rounded figure."""
    orders = load(spark, d, "orders", spread=True)
    prose = F.concat(
        F.lit("Invoice INV-"), F.col("o_orderkey").cast("string"), F.lit(" totals $"), _grouped(F.col("o_totalprice")),
        F.lit(" for client "), F.format_number("o_custkey", 0), F.lit("; around "),
        F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("k at a rate of "),
        F.format_string("%.1f", (F.col("o_orderkey") % 90 + 10) / 10.0), F.lit("%."),
    )
    found = orders.select("o_orderkey", N.find_numbers(prose).alias("f"))
    count = lambda cond: F.size(F.filter("f", cond)).cast("bigint")
    total = F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x["value"])
    return found.select(
        "o_orderkey",
        F.size("f").cast("bigint").alias("n_figures"),
        count(lambda x: x["approx"]).alias("n_approx"),
        count(lambda x: x["is_percent"]).alias("n_percent"),
        F.round(total, 2).alias("total"),
    )


@register(
    "find_dates",
    """
    select o_orderkey, 3::bigint as n_dates, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::bigint
      as lo, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::bigint as hi from orders
    """,
)
def find_dates(spark, d):
    """Each order date in three spellings next to an impossible date and a code that only looks like one."""
    orders = load(spark, d, "orders", spread=True)
    day = F.col("o_orderdate")
    prose = F.concat(
        F.lit("Placed "), F.date_format(day, "yyyy-MM-dd"), F.lit(", that is "), F.date_format(day, "d MMMM yyyy"),
        F.lit(" or "), F.date_format(day, "MMM d, yyyy"), F.lit("; not 2021-02-30 and not X2020-01-01-7."),
    )
    found = orders.select("o_orderkey", F.transform(N.find_dates(prose), lambda x: x["value"].cast("bigint")).alias("v"))
    return found.select(
        "o_orderkey", F.size("v").cast("bigint").alias("n_dates"), F.array_min("v").alias("lo"), F.array_max("v").alias("hi")
    )


_SMALL = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]


@register(
    "word_numbers",
    "select l_orderkey, l_linenumber, (l_linenumber + l_quantity % 13)::double as total, "
    "case when l_linenumber = 1 then 1 else 2 end::bigint as n_counts from lineitem",
)
def word_numbers(spark, d):
    items = load(spark, d, "lineitem", spread=True)
    words = F.array(*[F.lit(w) for w in _SMALL])
    name = lambda n: F.element_at(words, (n + 1).cast("int"))
    prose = F.concat(
        F.initcap(name(F.col("l_linenumber"))), F.lit(" of the "), name(F.col("l_quantity") % 13), F.lit(" twenty-fold items")
    )
    out = items.select("l_orderkey", "l_linenumber", N.word_numbers(prose).alias("w"), N.count_words(prose).alias("c"))
    return out.select(
        "l_orderkey",
        "l_linenumber",
        F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.size("c").cast("bigint").alias("n_counts"),
    )


@register("sql_literals", "select s_suppkey, 3 as n, s_suppkey + s_nationkey + 7.5::double as total from supplier")
def sql_literals(spark, d):
    """The numbers a query text states; digits in names and in quotes are none."""
    s = load(spark, d, "supplier")
    text = F.concat(F.lit("select v1 from t2 where a > "), F.col("s_suppkey").cast("string"), F.lit(" and b in ("), F.col("s_nationkey").cast("string"), F.lit(", 7.5) and c = '9'"))
    found = s.select("s_suppkey", N.sql_numbers(text).alias("v"))
    return found.select("s_suppkey", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@register(
    "evidence_values",
    "select p_partkey, 2 as n, round(p_retailprice, 2) as price, 7.0::double as word from part",
)
def evidence_values(spark, d):
    """A figure and a spelled-out number as evidence."""
    part = load(spark, d, "part")
    text = F.concat(F.lit("Each of the crates costs $"), F.format_number("p_retailprice", 2), F.lit(" and holds seven boxes"))
    found = part.select("p_partkey", N.evidence_numbers(text).alias("v"))
    return found.select("p_partkey", F.size("v").alias("n"), F.round(F.get("v", F.lit(0)), 2).alias("price"), F.get("v", F.lit(1)).alias("word"))


@register("evidence_numbers")
def evidence_numbers(spark, d):
    docs = load(spark, d, "documents").select("doc_id", N.evidence_numbers(F.col("text")).alias("v"))
    return docs.select("doc_id", F.size("v").alias("n_values"), F.round(F.array_max("v"), 4).alias("top_value"))


@register(
    "figure_match",
    """
    select p_partkey, true as exact_hit, true as whole_hit, true as about_hit,
      abs(floor(p_retailprice / 100) * 100 + 100 - p_retailprice) <= 0.5 as bare_hit from part
    """,
)
def figure_match(spark, d):
    """The price as written, rounded to a whole, rounded to hundreds with and without 'about'."""
    part = load(spark, d, "part", spread=True)
    price = F.col("p_retailprice")
    up = F.floor(price / 100) * 100 + 100
    near = F.bround(price / 100, 0) * 100
    text = lambda c: F.format_number(c, 0)
    first = lambda c: N.find_numbers(c)[0]
    claims = part.select(
        "p_partkey",
        F.array(F.lit(-1.0), price).alias("pool"),
        first(F.concat(F.lit("costs $"), F.format_number(price, 2))).alias("exact"),
        first(F.concat(F.lit("costs $"), text(F.round(price, 0)))).alias("whole"),
        first(F.concat(F.lit("costs about $"), text(near))).alias("about"),
        first(F.concat(F.lit("costs $"), text(up))).alias("bare"),
    )
    hit = lambda c: N.numbers_match(F.col(c), F.col("pool")).alias(f"{c}_hit")
    return claims.select("p_partkey", hit("exact"), hit("whole"), hit("about"), hit("bare"))


@register(
    "col_letter",
    """
    select l_orderkey, l_linenumber,
      case when k > 702 then chr((65 + ((k - 703) // 676)::int)) else '' end ||
      case when k > 26 then chr((65 + ((k - 27) // 26 % 26)::int)) else '' end || chr((65 + ((k - 1) % 26)::int)) as letters,
      k as back from (select *, (l_partkey % 16384 + 1)::bigint as k from lineitem)
    """,
)
def col_letter(spark, d):
    items = load(spark, d, "lineitem", spread=True).withColumn("k", F.col("l_partkey") % 16384 + 1)
    lettered = items.select("l_orderkey", "l_linenumber", A.col_letter(F.col("k")).alias("letters"))
    return lettered.withColumn("back", A.col_index(F.col("letters")))


@register(
    "merge_anchor",
    """
    select l_orderkey, l_linenumber, k as form,
      case when k = 0 then 'L' || lo || '-L' || (hi + 3) when k = 1 then 'R' || lo || '-R' || hi
           when k = 2 then '''My sheet''!A' || lo || ':H' || hi when k = 3 then 'p' || lo || '-p' || hi
           else 'p' || lo end as merged
    from (select l_orderkey, l_linenumber, l_orderkey % 5 as k, l_partkey as lo, l_partkey + l_linenumber as hi
          from lineitem)
    """,
)
def merge_anchor(spark, d):
    n = load(spark, d, "lineitem", spread=True).select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_orderkey") % 5).alias("form"),
        F.col("l_partkey").cast("string").alias("lo"),
        (F.col("l_partkey") + F.col("l_linenumber")).alias("hi"),
    )
    k, lo, hi = F.col("form"), F.col("lo"), F.col("hi").cast("string")
    first = (
        F.when(k == 0, F.concat(F.lit("L"), lo, F.lit("-L"), lo))
        .when(k == 1, F.concat(F.lit("R"), lo))
        .when(k == 2, F.concat(F.lit("'My sheet'!A"), lo, F.lit(":H"), lo))
        .otherwise(F.concat(F.lit("p"), lo))
    )
    last = (
        F.when(k == 0, F.concat(F.lit("L"), hi, F.lit("-L"), (F.col("hi") + 3).cast("string")))
        .when(k == 1, F.concat(F.lit("R"), hi))
        .when(k == 2, F.concat(F.lit("'My sheet'!A"), hi, F.lit(":H"), hi))
        .when(k == 3, F.concat(F.lit("p"), hi))
        .otherwise(first)
    )
    return n.select("l_orderkey", "l_linenumber", "form", A.merge_anchor(first, last).alias("merged"))


@register(
    "human_location",
    """
    select l_orderkey, l_linenumber,
      case k when 0 then 'page ' || p when 1 then 'slide ' || p || ' (table)' when 2 then 'slide ' || p || ' (notes)'
        when 3 then 'table ' || p || ', row ' || l_linenumber when 4 then 'paragraph ' || p || '–' || (p + 2)
        when 5 then 'sheet My data, cells A' || p || ':C' || (p + 1) when 6 then 'lines ' || p || '–' || (p + 4)
        else 'R' || p end as place
    from (select l_orderkey, l_linenumber, l_orderkey % 8 as k, l_partkey as p from lineitem)
    """,
)
def human_location(spark, d):
    n = load(spark, d, "lineitem", spread=True).withColumn("p", F.col("l_partkey")).withColumn("k", F.col("l_orderkey") % 8)
    s = lambda c: c.cast("string")
    p = F.col("p")
    forms = [
        ("pdf", F.concat(F.lit("page"), s(p), F.lit(".2"))),
        ("pptx", F.concat(F.lit("s"), s(p), F.lit(".t1"))),
        ("pptx", F.concat(F.lit("s"), s(p), F.lit(".notes"))),
        ("docx", F.concat(F.lit("t"), s(p), F.lit(".r"), s(F.col("l_linenumber")))),
        ("docx", F.concat(F.lit("p"), s(p), F.lit("-p"), s(p + 2))),
        ("xlsx", F.concat(F.lit("'My data'!A"), s(p), F.lit(":C"), s(p + 1))),
        ("md", F.concat(F.lit("L"), s(p), F.lit("-L"), s(p + 4))),
        ("csv", F.concat(F.lit("R"), s(p))),
    ]
    kind, anchor = F.lit(None), F.lit(None)
    for i, (t, a) in enumerate(forms):
        kind = F.when(F.col("k") == i, t).otherwise(kind)
        anchor = F.when(F.col("k") == i, a).otherwise(anchor)
    typed = n.select("l_orderkey", "l_linenumber", kind.alias("t"), anchor.alias("a"))
    return typed.select("l_orderkey", "l_linenumber", A.human_location(F.col("t"), F.col("a")).alias("place"))
