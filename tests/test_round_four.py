"""What round 4 found to grow in the driver or on disk: joins planned by the size of files, tables kept after their use."""

import importlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attestra.operators import results as R
from attestra.operators import verify as V
from attestra.operators.corpus import Corpus
from attestra.plans.verify_queries import table_citations
from attestra.session import MEASURED_LIMIT, STATIC_LIMIT, durable, measured_joins, passing, scratch_folder

USERS = [importlib.import_module(f"attestra.{m}") for m in ("operators.verify", "operators.evidence", "operators.refs", "scale")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def by_size(plan: str) -> list[str]:
    """Joins that send a table to every task, but for the starts of a sort's tasks, which are sent by name."""
    return [line.strip() for line in plan.splitlines() if "BroadcastHashJoin" in line and "_task#" not in line]


def sources(spark):
    docs = spark.createDataFrame([("list", "list.csv", "List", "csv")], "doc_id string, path string, title string, doc_type string")
    blocks = [("list", 0, "R1", "row", "", "name: rod | price: 12"), ("list", 1, "R2", "row", "", "name: bolt | price: 15")]
    blocks = spark.createDataFrame(blocks, "doc_id string, seq int, anchor string, kind string, section string, text string")
    results = spark.createDataFrame([], "result_id int, sql string, columns array<string>, source_files array<string>")
    return docs, blocks, results, spark.createDataFrame([], "result_id int, row_no int, row_json string")


@pytest.fixture(scope="module")
def checked(spark):
    """A verification and the plans of the tables it writes."""
    plans = []

    def spied(real):
        def durable(df):
            plans.append(plan_of(df))
            return real(df)

        return durable

    lines = ["The rod costs $12 [@list#R1].", 'It is so [@list#R2 "price: 15"].', "The bolt costs $9 [@list#R2].", "See [@nope#R1]."]
    drafts = spark.createDataFrame([("d", "\n\n".join(lines)), ("e", "")], "draft_id string, text string")
    limits = lambda: (spark.conf.get(STATIC_LIMIT), spark.conf.get(MEASURED_LIMIT, None))
    before = limits()
    with pytest.MonkeyPatch.context() as patch:
        for module in USERS:
            patch.setattr(module, "durable", spied(module.durable))
        result = V.verify(drafts, *sources(spark))
    assert limits() == before
    return result, plans


def test_no_table_of_a_check_is_sent_for_the_size_of_its_files(checked):
    result, plans = checked
    assert len(plans) > 10 and any("SortMergeJoin" in p for p in plans)
    assert [by_size(p) for p in plans if by_size(p)] == []
    for told in (result.report(), result.claim_pairs(), result.issues(), R.gate(result.drafts, result.report(), force=True)):
        assert by_size(plan_of(told)) == []


def test_report_lays_its_parts_over_each_other(checked):
    report = checked[0].report()
    assert "Join" not in plan_of(report)
    told = {r.draft_id: r.asDict() for r in report.collect()}
    assert told["d"] == dict(
        draft_id="d", units=4, units_exempt=0, units_cited=4, citations=4, citations_ok=3, figures_checked=2, figures_ok=1, errors=2, warnings=0, status="FAIL"
    )
    assert told["e"] == {n: 0 for n in told["d"]} | {"draft_id": "e", "status": "PASS"}


def test_table_citations_sends_no_counts_of_drafts(spark, tmp_path):
    part = spark.range(40).select(F.col("id").alias("p_partkey"), F.lit("bolt").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("S").alias("p_type"), F.lit(1).alias("p_size"), (F.col("id") + 900.5).alias("p_retailprice"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    told = table_citations(spark, str(tmp_path))
    assert by_size(plan_of(told)) == []
    assert sorted(map(tuple, told.collect())) == [(0, 10, 7, 0), (1, 10, 8, 0), (2, 0, 0, 10), (3, 10, 8, 0)]


def test_limits_come_back_after_an_error(spark):
    spark.conf.set(MEASURED_LIMIT, "1m")
    try:
        with pytest.raises(ZeroDivisionError), measured_joins(spark):
            assert (spark.conf.get(STATIC_LIMIT), spark.conf.get(MEASURED_LIMIT)) == ("-1", "1m")
            1 / 0
        assert spark.conf.get(MEASURED_LIMIT) == "1m" and spark.conf.get(STATIC_LIMIT) != "-1"
    finally:
        spark.conf.unset(MEASURED_LIMIT)


def test_passing_tables_go_but_for_those_kept(spark):
    rows = spark.range(3)
    with passing(spark):
        outer = durable(rows)
        with passing(spark):
            inner, kept = durable(rows), durable(rows, kept=True)
            assert inner.count() == kept.count() == 3
        gone = [f for f in inner.inputFiles() if Path(f.removeprefix("file://")).exists()]
        assert gone == [] and kept.count() == outer.count() == 3
        last = durable(rows, kept=True)
    files = outer.inputFiles() + kept.inputFiles()
    assert [f for f in files if Path(f.removeprefix("file://")).exists()] == [] and last.count() == 3


def test_an_ingest_leaves_its_version_and_the_list_for_its_report(spark, tmp_path):
    rows = [("a/x.md", "# X\n\n| k | v |\n|---|---|\n| a | 1 |\n"), ("a/y.html", "<h1>Y</h1><p>one</p>"), ("a/y.html", "<h1>Y</h1><p>one</p>"), ("a/z.txt", "\n".join("word %d\n" % i for i in range(1500)))]
    files = spark.createDataFrame(rows, "path string, text string")
    files = files.select("path", F.length("text").alias("size"), F.lit(1.0).alias("mtime"), F.sha2("text", 256).alias("sha256"), "text")
    scratch = Path(scratch_folder(spark).removeprefix("file://"))
    before = set(scratch.iterdir()) if scratch.exists() else set()
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    report = corpus.ingest(files)
    assert len(set(scratch.iterdir()) - before) == 1
    assert [(r.status, r.n, r.listed) for r in report.collect()] == [("new", 3, "a/x.md, a/y.html, a/z.txt")]
    assert sorted(p.name for p in (tmp_path / "corpus").iterdir()) == ["blocks", "cells", "chunks", "columns", "docs", "manifest"]
    n = {r.doc_id: r.n for r in corpus.read("blocks").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {"x": 2, "y": 4, "z": 1500}
    chunks = {}
    for r in corpus.read("chunks").orderBy("doc_id", "first_seq").collect():
        chunks.setdefault(r.doc_id, []).append(r)
    assert (len(chunks["x"]), sum(len(c.text.split("\n")) for c in chunks["z"])) == (1, 1500)
    # a file that is listed twice has its blocks twice, each as often as before
    assert sum(c.text.split("\n").count("one") for c in chunks["y"]) == 4
    assert [(r.r, r.c, r.v) for r in corpus.read("cells").orderBy("r", "c").collect()] == [(2, 1, "a"), (2, 2, "1")]
