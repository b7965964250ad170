"""SQL shapes, saved results, edits, corpus refresh and operations over the given tables."""

import uuid

from pyspark.sql import functions as F

from attestra.operators import edits as E
from attestra.operators import ingest as I
from attestra.operators import ops as O
from attestra.operators import results as R
from attestra.plans.derived import LINES_SQL, PART_CELLS_SQL, SECTIONED_SQL, part_cells, sectioned
from attestra.plans.registry import register
from attestra.session import load, scratch_folder
from attestra.sources import blocks as B


def tables(spark, d, *names):
    return {n: load(spark, d, n) for n in names}


AGG = """
    select l_returnflag, l_linestatus, round(avg(l_quantity), 6) as avg_qty, min(l_extendedprice) as low,
      count(*) filter (where l_discount >= 0.05) as n_discounted, count(*) as n
    from lineitem group by l_returnflag, l_linestatus
"""


@register("agg_filtered", AGG)
def agg_filtered(spark, d):
    return R.run_sql(spark, AGG, tables(spark, d, "lineitem"))


PARTS_SQL = """
  (select p_partkey, 'K' || p_partkey as part_no, p_size, p_retailprice, case p_partkey % 10 when 7 then 'A' when 8 then 'B' when 9 then 'alt'
     else 'baseline' end as option, case when p_partkey % 10 in (7, 8, 9) then 'K' || (p_partkey - 5) || '; K' || (p_partkey - 4) end as replaces
   from part)
"""


@register(
    "what_if",
    f"""
    with q as (select * from {PARTS_SQL}), opt as (select * from q where option = 'A' or part_no in ('K9', 'K19')),
    gone as (select distinct trim(unnest(string_split(replaces, ';'))) as part_no from opt where replaces is not null),
    parts as (select * from q where option = 'baseline' and part_no not in (select part_no from gone) union all select * from opt)
    select count(*) as n_parts, round(sum(p_size * p_retailprice), 2) as cost,
      round(100 * sum(p_size * p_retailprice) filter (where p_size > 25) / sum(p_size * p_retailprice), 4) as large_share from parts
    """,
)
def what_if(spark, d):
    part = load(spark, d, "part")
    k = F.col("p_partkey")
    option = F.when(k % 10 == 7, "A").when(k % 10 == 8, "B").when(k % 10 == 9, "alt").otherwise("baseline")
    name = lambda c: F.concat(F.lit("K"), c.cast("string"))
    base = part.select(
        name(k).alias("part_no"), "p_size", "p_retailprice", option.alias("option"),
        F.when(k % 10 >= 7, F.concat(name(k - 5), F.lit("; "), name(k - 4))).alias("replaces"),
    )
    parts = R.what_if(base, "part_no", "option", "replaces", "A", ["K9", "K19"])
    cost = F.col("p_size") * F.col("p_retailprice")
    return parts.agg(
        F.count("*").alias("n_parts"),
        F.round(F.sum(cost), 2).alias("cost"),
        F.round(100 * F.sum(F.when(F.col("p_size") > 25, cost)) / F.sum(cost), 4).alias("large_share"),
    )


FILTER = "select p_partkey, p_name, p_retailprice from part where p_retailprice < 1000 and p_size <= 20 order by p_name, p_partkey"


@register("filter_order", FILTER)
def filter_order(spark, d):
    return R.run_sql(spark, FILTER, tables(spark, d, "part"))


@register(
    "probe_nulls",
    """
    select 'o_orderkey' as "column", count(*) as n_rows, count(*) - count(o_orderkey) as n_null from orders
    union all select 'rush', count(*), count(*) - count(case when o_orderpriority like '1%' then 1 end) from orders
    """,
)
def probe_nulls(spark, d):
    o = load(spark, d, "orders")
    return R.probe(o.select("o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), F.lit(1)).alias("rush")))


SHARE = """
    select l_returnflag, l_linestatus, round(100 * sum(l_extendedprice) / sum(sum(l_extendedprice)) over (), 4) as share_pct,
      round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) as discount_ratio,
      case when avg(l_quantity) >= 25.5 then 'pass' else 'fail' end as verdict
    from lineitem group by l_returnflag, l_linestatus
"""


@register("share_passfail", SHARE)
def share_passfail(spark, d):
    return R.run_sql(spark, SHARE, tables(spark, d, "lineitem"))


RANK = """
    with s as (select s_suppkey, s_nationkey, s_acctbal from supplier),
    n as (select s_nationkey, count(*) as n, count(case when s_acctbal >= 0 then 1 end) as n_pass, round(sum(s_acctbal), 2) as total from s group by s_nationkey)
    select s_nationkey, n, n_pass, total, cast(rank() over (order by n_pass desc) as bigint) as by_pass,
      cast(dense_rank() over (order by total desc, s_nationkey) as bigint) as by_total from n
"""


@register("rank_compare", RANK)
def rank_compare(spark, d):
    """Nations ranked; the ranking runs over one row per nation, not over suppliers."""
    return R.run_sql(spark, RANK, tables(spark, d, "supplier"))


TARGETS = """
    with t(flag, measure, floor_value) as (values ('A', 'qty', 20.0), ('A', 'disc', 0.06), ('N', 'qty', 30.0), ('R', 'disc', 0.02)),
    m as (select n_name, l_returnflag, avg(l_quantity) as qty, avg(l_discount) as disc from lineitem
      join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by n_name, l_returnflag),
    u as (select n_name, l_returnflag, 'qty' as measure, qty as v from m union all select n_name, l_returnflag, 'disc', disc from m)
    select n_name, u.measure as measure, l_returnflag, round(v, 6) as v, v >= floor_value as met
    from u join t on t.flag = u.l_returnflag and t.measure = u.measure
"""


@register("targets_join", TARGETS)
def targets_join(spark, d):
    return R.run_sql(spark, TARGETS, tables(spark, d, "lineitem", "supplier", "nation"))


@register(
    "summarize",
    """
    select 's_acctbal' as column_name, min(s_acctbal)::varchar as min, max(s_acctbal)::varchar as max, count(*) as count, round(avg(s_acctbal), 4) as avg,
      round(stddev(s_acctbal), 4) as std, 0.0::double as null_percentage from supplier
    union all select 's_name', min(s_name), max(s_name), count(*), null, null, 0.0 from supplier
    """,
)
def summarize(spark, d):
    s = R.run_sql(spark, "SUMMARIZE supplier", tables(spark, d, "supplier"))
    return s.filter("column_name in ('s_acctbal', 's_name')").select(
        "column_name", "min", "max", "count", F.round("avg", 4).alias("avg"), F.round("std", 4).alias("std"), "null_percentage"
    )


@register(
    "row_cap",
    "select o_orderkey, (select count(*) > 1000 from orders) as more from orders order by o_totalprice desc, o_orderkey limit 1000",
)
def row_cap(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.row_cap(o, [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "more")


SAVED = "select o_orderkey, o_custkey, o_orderstatus, o_orderdate from orders where o_orderstatus <> 'P'"


@register(
    "save_result",
    """
    with s as (select *, row_number() over (order by o_orderdate desc, o_orderkey) as row_no, count(*) over () as row_count from orders where o_orderstatus <> 'P')
    select 1 as result_id, row_count, 'orders' as tables, false as more, row_no, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey ||
      ',"o_orderstatus":"' || o_orderstatus || '","o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"}' as row_json from s
    """,
)
def save_result(spark, d):
    """A result of any number of rows saved with its query and sources, and read back whole."""
    folder = f"{scratch_folder(spark)}/results-{uuid.uuid4().hex}"
    df = R.run_sql(spark, SAVED, tables(spark, d, "orders"))
    number = R.save_result(spark, df, [F.col("o_orderdate").desc(), "o_orderkey"], SAVED, {"orders": "data/orders.parquet"}, folder)
    head, rows = R.read_result(spark, folder, number, shown=None)
    info = head.select("result_id", "row_count", "more", F.array_join("tables", ",").alias("tables"))
    return rows.join(info, "result_id").select("result_id", "row_count", "tables", "more", "row_no", "row_json")


@register(
    "export_results",
    """
    select 'calc:1' as result, (select count(*) from orders) as row_count, o_orderkey as k, o_orderdate::date as day, o_totalprice as v from orders
    union all select 'calc:2', (select count(*) from nation), n_nationkey, null, n_regionkey::double from nation
    """,
)
def export_results(spark, d):
    """Two saved results exported with their types and read back beside their provenance."""
    folder = f"{scratch_folder(spark)}/results-{uuid.uuid4().hex}"
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("v"))
    nation = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v"))
    R.save_result(spark, orders, ["k"], "select * from orders", {"orders": "orders.parquet"}, folder)
    R.save_result(spark, nation, ["k"], "select * from nation", {"nation": "nation.parquet"}, folder)
    kept = R.export_results(spark, folder, [1, 2], f"{folder}/out").select("result", "row_count")
    one = spark.read.parquet(f"{folder}/out/result_1").select(F.lit("calc:1").alias("result"), "k", "day", "v")
    two = spark.read.parquet(f"{folder}/out/result_2").select(F.lit("calc:2").alias("result"), "k", F.lit(None).cast("date").alias("day"), "v")
    return one.unionByName(two).join(kept, "result").select("result", "row_count", F.col("k").cast("long").alias("k"), "day", "v")


@register(
    "chart_data",
    """
    with m as (select o_orderpriority as x, count(*)::double as n_orders, round(sum(o_totalprice), 2) as total,
      sum(case when o_orderstatus = 'P' then 1 end)::double as n_open from orders group by 1)
    select x, 'n_orders' as series, n_orders as value from m union all select x, 'total', total from m union all select x, 'n_open', coalesce(n_open, 0) from m
    """,
)
def chart_data(spark, d):
    o = load(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.sum(F.when(F.col("o_orderstatus") == "P", 1)).alias("n_open"),
    )
    return R.chart_data(o)


@register(
    "split_sections",
    f"""
    with l as (select doc_id, unnest(string_split({SECTIONED_SQL}, chr(10))) as line,
        generate_subscripts(string_split({SECTIONED_SQL}, chr(10)), 1) as ln from documents),
    n as (select *, row_number() over (partition by doc_id order by ln) as seq from l where trim(line) <> ''),
    k as (select *, doc_id % 2 = 0 and seq % 4 = 0 as is_rule, seq = 1 or seq % 5 = 0 as head from n),
    e as (select *, bool_or(is_rule) over (partition by doc_id) as explicit from k),
    p as (select *, sum(case when explicit then is_rule::int else head::int end) over (partition by doc_id order by seq) as part from e)
    select doc_id, seq::int as seq, dense_rank() over (partition by doc_id order by part)::int as section_no from p where not is_rule
    """,
)
def split_sections(spark, d):
    """Lines of sectioned documents; in even documents every fourth is a rule, elsewhere every fifth starts a section."""
    docs = sectioned(spark, d)
    lines = docs.select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("ls"))
    seq = lines.select("doc_id", F.posexplode("ls").alias("i", "line")).withColumn("seq", F.col("i") + 1)
    kind = (
        F.when((F.col("doc_id") % 2 == 0) & (F.col("seq") % 4 == 0), "rule")
        .when((F.col("seq") == 1) | (F.col("seq") % 5 == 0), "heading")
        .otherwise("para")
    )
    level = F.when(F.col("seq") == 1, 1).otherwise(2)
    out = R.split_sections(seq.select("doc_id", "seq", kind.alias("kind"), level.alias("level")))
    return out.select("doc_id", "seq", "section_no")


@register(
    "apply_cell_edits",
    f"""
    with c as (select doc_id, sheet, r, c, v from {PART_CELLS_SQL}),
    e as (select 'book' || p_partkey // 1600 as doc_id, 'Parts ' || p_partkey // 400 as sheet, (p_partkey % 400 + 5)::int as r, 4 as c,
            'Brand of ' || p_partkey as nv from part where p_partkey % 9 = 0)
    select c.doc_id, c.sheet, c.r, c.c, coalesce(nv, v) as v from c left join e using (doc_id, sheet, r, c)
    """,
)
def apply_cell_edits(spark, d):
    """The brand cell of every ninth part is set; references to sheets that do not exist are refused."""
    part = load(spark, d, "part").filter(F.col("p_partkey") % 9 == 0)
    k = F.col("p_partkey")
    sheet = F.concat(F.lit("Parts "), F.floor(k / 400).cast("string"))
    ref = F.concat(F.lit("'"), sheet, F.lit("'!$D"), (k % 400 + 5).cast("string"))
    doc = F.concat(F.lit("book"), F.floor(k / 1600).cast("string"))
    edits = part.select(doc.alias("doc_id"), ref.alias("ref"), F.concat(F.lit("Brand of "), k.cast("string")).alias("value"))
    lost = part.select(doc.alias("doc_id"), F.lit("Nowhere!A1").alias("ref"), F.lit("x").alias("value"))
    after, _, _ = E.apply_cell_edits(part_cells(spark, d), edits.unionByName(lost))
    return after.select("doc_id", "sheet", "r", "c", "v")


@register(
    "replace_text",
    f"select doc_id, seq, md5(replace(text, 'tion', 'TION-tion')) as text, ((length(text) - length(replace(text, 'tion', ''))) // 4)::bigint as n "
    f"from {LINES_SQL} where contains(text, 'tion')",
)
def replace_text(spark, d):
    out = E.replace_text(B.line_blocks(load(spark, d, "documents")), "tion", "TION-tion")
    return out.select("doc_id", "seq", F.md5("text").alias("text"), "n")


@register(
    "append_blocks",
    f"""
    with b as (select doc_id, seq, text from {LINES_SQL}), n as (select doc_id, max(seq) + 1 as n from b group by 1)
    select doc_id, seq::int as seq, md5(text) as text from b union all
    select c.doc_id, (n.n + c.seq)::int, md5(c.text) from b c join n using (doc_id) where c.doc_id % 3 = 0
    """,
)
def append_blocks(spark, d):
    """Every third document is appended to itself."""
    b = B.line_blocks(load(spark, d, "documents")).select("doc_id", "seq", "text")
    out = E.append_blocks(b, b.filter(F.col("doc_id") % 3 == 0))
    return out.select("doc_id", F.col("seq").cast("int").alias("seq"), F.md5("text").alias("text"))


SNAP_SQL = """
  old as (select o_orderkey as path, (o_orderkey % 97)::bigint as size, o_totalprice as mtime, md5(o_orderpriority) as sha256 from orders where o_orderkey % 11 <> 3),
  new as (select o_orderkey as path, (o_orderkey % 97 + case when o_orderkey % 13 = 5 then 1 else 0 end)::bigint as size,
    o_totalprice + case when o_orderkey % 7 = 2 then 1 else 0 end as mtime,
    md5(o_orderpriority || case when o_orderkey % 13 = 5 then 'x' else '' end) as sha256 from orders where o_orderkey % 11 <> 8),
  diff as (select coalesce(o.path, n.path) as path, case when o.path is null then 'new' when n.path is null then 'deleted'
    when o.size <> n.size or abs(o.mtime - n.mtime) > 1e-6 then 'modified' else 'unchanged' end as status from old o full join new n on o.path = n.path),
  confirmed as (select d.path, case when status = 'modified' and o.sha256 = n.sha256 then 'touched' else status end as status
    from diff d left join old o on d.path = o.path left join new n on d.path = n.path)
"""


def snapshots(spark, d):
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    changed, touched = k % 13 == 5, k % 7 == 2
    old = o.filter(k % 11 != 3).select(
        k.alias("path"), (k % 97).alias("size"), F.col("o_totalprice").alias("mtime"), F.md5("o_orderpriority").alias("sha256")
    )
    new = o.filter(k % 11 != 8).select(
        k.alias("path"),
        (k % 97 + F.when(changed, 1).otherwise(0)).alias("size"),
        (F.col("o_totalprice") + F.when(touched, 1).otherwise(0)).alias("mtime"),
        F.md5(F.concat("o_orderpriority", F.when(changed, "x").otherwise(""))).alias("sha256"),
    )
    return old, new


@register("snapshot_diff", f"with {SNAP_SQL} select path, status from diff")
def snapshot_diff(spark, d):
    return I.snapshot_diff(*snapshots(spark, d))


@register("hash_confirm", f"with {SNAP_SQL} select path, status from confirmed")
def hash_confirm(spark, d):
    old, new = snapshots(spark, d)
    return I.hash_confirm(I.snapshot_diff(old, new), old, new)


@register(
    "ingest_report",
    f"""
    with {SNAP_SQL}, r as (select *, row_number() over (partition by status order by path) as rn, count(*) over (partition by status) as n from confirmed)
    select status, any_value(n) as n, string_agg(path::varchar, ', ' order by path::varchar) || case when any_value(n) > 30 then ' …' else '' end as listed
    from r where rn <= 30 group by 1
    """,
)
def ingest_report(spark, d):
    old, new = snapshots(spark, d)
    return I.ingest_report(I.hash_confirm(I.snapshot_diff(old, new), old, new))


@register(
    "apply_changes",
    "select doc_id, md5(case when doc_id % 5 = 1 then 'v2 ' || text else text end) as text from documents where doc_id % 5 <> 4",
)
def apply_changes(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    fresh = docs.filter(F.col("doc_id") % 5 == 1).withColumn("text", F.concat(F.lit("v2 "), "text"))
    kept = I.apply_changes(docs, fresh, docs.filter(F.col("doc_id") % 5 == 4))
    return kept.select("doc_id", F.md5("text").alias("text"))


@register(
    "with_errors",
    """
    select event_id, case when event_id % 17 = 0 then null else (props->>'k')::bigint end as k, case when event_id % 17 = 0 then 'unreadable props' end as error
    from events
    """,
)
def with_errors(spark, d):
    """Event properties, every seventeenth cut short so that it cannot be read."""
    e = load(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 17 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("props")
    )
    good, bad = I.with_errors(e, F.get_json_object("props", "$.k").try_cast("bigint"), "k", "unreadable props")
    none = F.lit(None).cast("string")
    return good.select("event_id", "k", none.alias("error")).unionByName(bad.select("event_id", F.lit(None).cast("bigint").alias("k"), "error"))


def _case(rules):
    return " ".join(f"when regexp_matches(t, '(?i){rx}') then '{name}'" for name, rx in rules)


@register(
    "route_text",
    "select conv_id, turn, case when length(t) < 12 or substr(t, 1, 1) in ('/', '!', '#', '<') then null "
    + _case(O.ROUTES)
    + " end as route from (select conv_id, turn, trim(text || ' ' || role || case turn % 4 when 0 then ' please compare' when 1 then ' into slides' "
    "when 2 then ' what now' else '' end) as t from conversations)",
)
def route_text(spark, d):
    """Turns of conversations, most with a request added at the end."""
    tail = F.element_at(F.array(F.lit(" please compare"), F.lit(" into slides"), F.lit(" what now"), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    c = load(spark, d, "conversations").withColumn("t", F.concat("text", F.lit(" "), "role", tail))
    return c.select("conv_id", "turn", O.route(F.col("t")).alias("route"))


@register("session_budget", "select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn) as rn from conversations) where rn <= 3")
def session_budget(spark, d):
    return O.budget(load(spark, d, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn")


@register("once_per_session", "select conv_id, role, min(turn) as turn from conversations group by 1, 2")
def once_per_session(spark, d):
    return O.once(load(spark, d, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn")


@register("latest_role", "select conv_id, max_by(role, turn) as latest from conversations group by 1")
def latest_role(spark, d):
    return O.latest(load(spark, d, "conversations"), ["conv_id"], "turn", "role")


@register(
    "usage_cost",
    """
    with m as (select role as agent, case conv_id % 4 when 0 then 'm-opus-x' when 1 then 'm-sonnet-x' when 2 then 'm-haiku-x' else '<synthetic>' end as model,
        conv_id || '-' || turn as message_id, length(text) as i, length(text) // 2 as o, turn as r, conv_id % 5 as w from conversations),
    p as (select agent, model, case conv when 'o' then 4.0 when 's' then 2.0 else 1.0 end as pi, case conv when 'o' then 20.0 when 's' then 10.0 else 5.0 end as po, i, o, r, w
      from (select *, case when model like '%opus%' then 'o' when model like '%sonnet%' then 's' else 'h' end as conv from m where model not like '<%')),
    t as (select agent, model, sum(((i + r * 0.1 + w * 2.0) * pi + o * po) / 1e6) as usd from p group by 1, 2)
    select agent, model, round(usd, 8)::double as usd, round(usd / sum(usd) over (), 6)::double as share from t
    """,
)
def usage_cost(spark, d):
    """Turns as messages: text length as tokens, every message sent twice."""
    c = load(spark, d, "conversations")
    models = F.array(F.lit("m-opus-x"), F.lit("m-sonnet-x"), F.lit("m-haiku-x"), F.lit("<synthetic>"))
    m = c.select(
        F.col("role").alias("agent"), F.element_at(models, (F.col("conv_id") % 4 + 1).cast("int")).alias("model"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        F.length("text").cast("long").alias("input_tokens"), F.floor(F.length("text") / 2).cast("long").alias("output_tokens"),
        F.col("turn").alias("cache_read"), (F.col("conv_id") % 5).alias("cache_write"),
    )
    cost = O.usage_cost(m.unionByName(m))
    return cost.select("agent", "model", F.round("usd", 8).alias("usd"), F.round("share", 6).alias("share"))
