"""What is worked out once is not worked out again: plans and counts of the steps that round 3 found slow."""

import contextlib

from pyspark.sql import functions as F

from attestra.operators import refs as R
from attestra.operators.corpus import Corpus
from attestra.operators.verify import split_units
from attestra.sources import grid


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_outline_reads_its_blocks_once(spark):
    rows = [("d", 0, "p1", "heading", "top", 1), ("d", 1, "p2", "para", "x" * 150, None), ("e", 0, "p1", "para", "y" * 95, None)]
    blocks = spark.createDataFrame(rows, "doc_id string, seq int, anchor string, kind string, text string, level int")
    items = R.outline(blocks.withColumn("text", F.upper("text")), "html")
    assert "upper(" not in plan_of(items).lower()
    assert sorted(map(tuple, items.collect())) == [("d", 0, "[p1] TOP  (1 blocks)"), ("e", 0, "[p1] " + "Y" * 90)]


@contextlib.contextmanager
def setting(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def test_cells_are_not_sorted_to_be_trimmed(spark):
    rows = [("b", "s", 1, 1, "x"), ("b", "s", 2, 1, " "), ("b", "s", 1, 3, None), ("b", "t", 1, 1, ""), (None, "s", 1, 1, "n")]
    cells = spark.createDataFrame(rows, "doc_id string, sheet string, r int, c int, v string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        inside = grid.trim_grid(cells)
        assert "SortMergeJoin" not in plan_of(inside)
        assert [(r.doc_id, r.sheet, r.r, r.c, r.v) for r in inside.collect()] == [("b", "s", 1, 1, "x")]


def test_texts_are_made_once_for_the_listing_and_once_to_be_read(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def made(text):
        seen.add(1)
        return text

    rows = [(f"a/f{i}.md", f"# Head {i}\n\nbody {i}") for i in range(5)]
    files = spark.createDataFrame(rows, "path string, t string").select("path", F.udf(made, "string")("t").alias("text"))
    files = files.select("path", F.length("text").alias("size"), F.lit(1.0).alias("mtime"), F.sha2("text", 256).alias("sha256"), "text")
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    report = {r.status: r.n for r in corpus.ingest(files).collect()}
    assert report == {"new": 5}
    assert seen.value <= 10
    assert corpus.read("blocks").count() == 10


def test_units_of_text_and_tables_come_out_of_one_pass(spark):
    text = "First line\ngoes on.\n- item one\n\n### Prices [@a]\n\n| Part | Price |\n|---|---|\n| x | $1 |\n| y | $2 [@b] |\n\n> quoted"
    units = split_units(spark.createDataFrame([("d", text)], "draft_id string, text string"))
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    told = sorted((r.line, r.text, r.table_exempt) for r in units.collect())
    assert told == [(1, "First line goes on.", False), (3, "- item one", False), (9, "| x | $1 | [@a]", False), (10, "| y | $2 [@b] |", False), (12, "quoted", False)]
