"""Inputs that Spark derives from the given tables, each with the SQL that derives the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.session import load

# ---- documents as Markdown: a heading line, then one paragraph per line that ends with a full stop
SECTIONED_SQL = "'# ' || replace(text, '.' || chr(10), '.' || chr(10) || chr(10))"


def sectioned(spark, d) -> DataFrame:
    docs = load(spark, d, "documents")
    text = F.concat(F.lit("# "), F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n")))
    return docs.select("doc_id", "source", text.alias("text"))


# ---- part as workbooks: 400 parts a sheet, header in row 4 from column B, a title, a note, junk blanks
PART_CELLS_SQL = """
  (with p as (select *, p_partkey // 400 as s, (p_partkey % 400 + 5)::int as r from part),
   s as (select distinct s from p)
   select 'book' || s // 4 as doc_id, 'Parts ' || s as sheet, r::int as r, c::int as c, v, kind, formula from (
     select s, 1 as r, 1 as c, 'Part list ' || s as v, 's' as kind, null as formula from s
     union all select s, 2, 1, 'prices in USD', 's', null from s
     union all select s, 4, c, v, 's', null from s, (values (2, 'Part key'), (3, 'Name'), (4, 'Brand'), (5, 'Size'),
       (6, 'Retail price'), (7, 'Note')) t(c, v)
     union all select s, 500, 12, ' ', 's', null from s
     union all select s, r, 2, p_partkey::varchar, 'i', null from p
     union all select s, r, 3, p_name, 's', null from p
     union all select s, r, 4, p_brand, 's', null from p
     union all select s, r, 5, case when p_partkey % 20 = 3 then 'n/a' else p_size::varchar end,
       case when p_partkey % 20 = 3 then 's' else 'i' end, null from p
     union all select s, r, 6, case when p_partkey % 25 = 7 then 'on request' when p_partkey % 50 = 9 then null
       else p_retailprice::varchar end, case when p_partkey % 25 = 7 then 's' when p_partkey % 50 = 9 then null else 'f' end,
       case when p_partkey % 50 = 9 then '=E1*2' end from p
     union all select s, r, 7, case when p_partkey % 3 = 0 then p_type else '' end, 's', null from p))
"""

NAMES = ["Part key", "Name", "Brand", "Size", "Retail price", "Note"]


def part_cells(spark, d) -> DataFrame:
    p = load(spark, d, "part", spread=True)
    k = F.col("p_partkey")
    sheet_no = F.floor(k / 400)

    def cell(c, v, kind, formula=None):
        return F.struct(
            F.lit(c).alias("c"),
            v.cast("string").alias("v"),
            kind.alias("kind") if not isinstance(kind, str) else F.lit(kind).alias("kind"),
            (formula if formula is not None else F.lit(None).cast("string")).alias("formula"),
        )

    na, ask, calc = k % 20 == 3, k % 25 == 7, k % 50 == 9
    row = F.array(
        cell(2, k, "i"),
        cell(3, F.col("p_name"), "s"),
        cell(4, F.col("p_brand"), "s"),
        cell(5, F.when(na, "n/a").otherwise(F.col("p_size").cast("string")), F.when(na, "s").otherwise("i")),
        cell(
            6,
            F.when(ask, "on request").when(calc, None).otherwise(F.col("p_retailprice").cast("string")),
            F.when(ask, "s").when(calc, None).otherwise("f"),
            F.when(calc & ~ask, "=E1*2").when(calc, "=E1*2"),
        ),
        cell(7, F.when(k % 3 == 0, F.col("p_type")).otherwise(""), "s"),
    )
    data = p.select(sheet_no.alias("s"), (k % 400 + 5).cast("int").alias("r"), F.explode(row).alias("x"))
    top = p.select(sheet_no.alias("s")).distinct()

    def fixed(r, c, v):
        return F.struct(F.lit(r).alias("r"), cell(c, v, "s").alias("x"))

    heads = [fixed(4, i + 2, F.lit(n)) for i, n in enumerate(NAMES)]
    title = F.concat(F.lit("Part list "), F.col("s").cast("string"))
    frame = top.select(
        "s",
        F.explode(F.array(fixed(1, 1, title), fixed(2, 1, F.lit("prices in USD")), *heads, fixed(500, 12, F.lit(" ")))).alias("f"),
    ).select("s", "f.r", "f.x")
    return data.unionByName(frame).select(
        F.concat(F.lit("book"), F.floor(F.col("s") / 4).cast("string")).alias("doc_id"),
        F.concat(F.lit("Parts "), F.col("s").cast("string")).alias("sheet"),
        "r", "x.c", "x.v", "x.kind", "x.formula",
    )


# ---- documents in line mode: every line a block
LINES_SQL = """
  (select * from (select doc_id, (ln - 1)::int as seq, ln, 'L' || ln as anchor, trim(line) as text, source
   from (select doc_id, source, unnest(string_split(text, chr(10))) as line,
     generate_subscripts(string_split(text, chr(10)), 1) as ln from documents)) where text <> '')
"""
