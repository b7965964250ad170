"""What the plans must look like, and a few registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from attestra.operators import ops as O
from attestra.operators import search as S
from attestra.plans import ORACLES, QUERIES
from attestra.sources import blocks as B
from attestra.sources import html

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrow_jobs_do_not_shuffle(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for df in (B.line_blocks(docs), html.html_blocks(pages), html.page_links(pages), S.postings(docs.select(F.col("doc_id").alias("chunk_id"), "text"))):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text


@pytest.mark.parametrize(
    "name,read,pushed",
    [
        ("agg_filtered", "FileScan parquet [l_quantity#", None), ("tokenize", "ReadSchema: struct<doc_id:bigint,text:string>", None), ("rank_compare", "ReadSchema: struct<s_nationkey:int,s_acctbal:double>", None),
        ("filter_order", "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int,p_retailprice:double>", "LessThan(p_retailprice,1000.0)"), ("snippet", "ReadSchema: struct<doc_id:bigint,text:string>", "IsNotNull(text)"),
    ],
)
def test_scans_are_pruned_and_filters_pushed(spark, name, read, pushed):
    """Our own queries: only the columns they need are read, and their filters reach the scan."""
    text = plan(QUERIES[name](spark, SMALL))
    assert read in text and (pushed is None or pushed in text)


def test_ranked_groups_are_cut_before_the_shuffle(spark):
    c = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert "WindowGroupLimit" in plan(O.budget(c, ["conv_id"], ["turn"]))
    scored = c.select(F.col("conv_id").alias("search_id"), F.col("turn").alias("chunk_id"), F.col("role").alias("doc_id"), F.rand(1).alias("score"))
    assert "WindowGroupLimit" in plan(S.top_ranked(scored, ["search_id"], 20))
    assert "WindowGroupLimit" in plan(S.diversify(scored, 8, ["search_id"]))


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 100


@pytest.mark.parametrize("name", ["slugify", "segment_text", "pipe_tables", "row_text", "infer_types", "bm25_or", "resolve_range", "snapshot_diff", "agg_filtered", "split_units"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    tidy = lambda rows, names: sorted(
        tuple(str(round(r[names.index(c)], 4)) if isinstance(r[names.index(c)], float) else str(r[names.index(c)]) for c in sorted(names)) for r in rows
    )
    assert sorted(cols) == sorted(df.columns)
    assert tidy([tuple(r) for r in df.collect()], df.columns) == tidy(cur.fetchall(), cols)
