import os

import pytest
from pyspark.sql import functions as F

from attestra.operators import edits as E
from attestra.operators import ingest as I
from attestra.operators import ops as O
from attestra.operators import results as R
from attestra.streaming.refresh import current_docs, stream_ingest


def quotes(spark):
    rows = [("K1", "baseline", None, 2.0), ("K2", "baseline", None, 3.0), ("K3", "A", "K1; K2", 4.0), ("K4", "alt", "K2", 1.0)]
    return spark.createDataFrame(rows, "part_no string, option string, replaces string, cost double")


def test_sql_is_read_only(spark):
    t = {"quotes": quotes(spark)}
    assert R.run_sql(spark, "select count(*) n from quotes;", t).first().n == 4
    assert R.run_sql(spark, "select 'drop table; parquet.`x`' a from quotes limit 1", t).first().a
    for bad in ("drop table quotes", "  INSERT into quotes values (1)", "select * from parquet.`/etc`", "select * from csv . `/etc/hosts`", "select 1; select 2", "set x=1", "with a as (select 1) insert into quotes select * from a"):
        with pytest.raises(R.SqlRefused):
            R.run_sql(spark, bad, t)
    with pytest.raises(R.SqlRefused, match="catalog"):
        R.run_sql(spark, "select * from nowhere", t)


def test_what_if(spark):
    cost = lambda pick, extra=None: R.what_if(quotes(spark), "part_no", "option", "replaces", pick, extra).agg(F.sum("cost")).first()[0]
    assert (cost("none"), cost("A"), cost("none", ["K4"]), cost("A", ["K4"])) == (5.0, 4.0, 3.0, 5.0)


def test_results_are_saved_with_sources(spark, tmp_path):
    df = spark.sql("select * from values (date'2024-01-02', 1.5bd, 'x', true), (null, 2bd, '7', false) t(d, n, s, b)")
    folder = str(tmp_path / "r")
    sources = {"t1": "a/t1.csv", "t2": "a/t2.csv"}
    assert R.save_result(spark, df, ["n"], "select * from t2", sources, folder) == 1
    assert R.save_result(spark, df.limit(1), ["n"], "select * from t1 join t2", sources, folder) == 2
    head, rows = R.read_result(spark, folder, 1)
    assert (head.first().row_count, head.first().source_files) == (2, ["a/t2.csv"])
    assert rows.collect()[0].row_json == '{"d":"2024-01-02","n":1.5,"s":"x","b":true}'
    prov = R.export_results(spark, folder, [1, 2], str(tmp_path / "out")).orderBy("result").collect()
    assert [p.result for p in prov] == ["calc:1", "calc:2"] and prov[1].source_files == "a/t1.csv, a/t2.csv"
    back = spark.read.parquet(str(tmp_path / "out/result_1"))
    assert dict(back.dtypes) == {"d": "date", "n": "double", "s": "string", "b": "string"}


def test_row_cap_and_chart(spark):
    df = spark.range(10).withColumn("v", F.when(F.col("id") != 3, F.col("id") * 2))
    kept = R.row_cap(df, ["id"], 4).collect()
    assert len(kept) == 4 and kept[0].more and not R.row_cap(df, ["id"], 10).first().more
    assert {(r.x, r.value) for r in R.chart_data(df, "id").collect() if r.series == "v"} >= {("3", 0.0), ("4", 8.0)}
    with pytest.raises(ValueError):
        R.chart_data(df, "nope")


def test_edits(spark):
    cells = spark.createDataFrame([("d", "My sheet", 1, 2, "old")], "doc_id string, sheet string, r int, c int, v string")
    edits = spark.createDataFrame([("d", "'My sheet'!$B1", "new"), ("d", "'My sheet'!AA7", "=1"), ("d", "Nope!A1", "x"), ("d", "A-1", "x")], "doc_id string, ref string, value string")
    after, changes, refused = E.apply_cell_edits(cells, edits)
    assert {(r.r, r.c): r.v for r in after.collect()} == {(1, 2): "new", (7, 27): "=1"}
    assert {(r.old, r.new) for r in changes.collect()} == {("old", "new"), (None, "=1")}
    assert {r.ref: r.reason for r in refused.collect()} == {"Nope!A1": "no such sheet", "A-1": "bad cell reference"}
    b = spark.createDataFrame([(1, "aaa"), (2, "b")], "id int, text string")
    assert [(r.text, r.n) for r in E.replace_text(b, "a", "aa").collect()] == [("aaaaaa", 3)]
    with pytest.raises(ValueError):
        E.replace_text(b, "", "x")


def test_refresh(spark):
    old = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 1, 1.0, "y"), ("c", 1, 1.0, "z"), ("e", 1, 1.0, "q")], "path string, size int, mtime double, sha256 string")
    new = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 1, 2.0, "y"), ("d", 1, 1.0, "z"), ("e", 1, 3.0, "r")], "path string, size int, mtime double, sha256 string")
    diff = I.hash_confirm(I.snapshot_diff(old, new), old, new)
    assert {r.path: r.status for r in diff.collect()} == {"a": "unchanged", "b": "touched", "c": "deleted", "d": "new", "e": "modified"}
    many = spark.range(40).select(F.format_string("p%02d", "id").alias("path"), F.lit("new").alias("status"))
    rep = I.ingest_report(many).first()
    assert rep.n == 40 and rep.listed.startswith("p00, p01") and rep.listed.endswith("p29 …")


def test_routes(spark):
    texts = ["make a deck of results", "please write-up the summary", "which frame is best?", "/what is this one", "hm what", "nothing to match here"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(O.route(F.col("t"))).collect()] == ["deck", "report", "ask", None, None, None]


def test_usage(spark):
    rows = [("main", "x-opus-1", "1", 1000000, 0, 0, 0), ("main", "x-opus-1", "1", 1000000, 0, 0, 0), ("sub", "y-haiku", "2", 0, 1000000, 1000000, 1000000), ("sub", "<synthetic>", "3", 9, 9, 9, 9)]
    df = spark.createDataFrame(rows, "agent string, model string, message_id string, input_tokens long, output_tokens long, cache_read long, cache_write long")
    got = {r.agent: (round(r.usd, 6), round(r.share, 4)) for r in O.usage_cost(df).collect()}
    assert got == {"main": (4.0, round(4 / 11.1, 4)), "sub": (7.1, round(7.1 / 11.1, 4))}


def test_stream_takes_in_new_files_once(spark, tmp_path):
    src, table, ckpt = (str(tmp_path / x) for x in ("src", "table", "ckpt"))
    os.makedirs(src)
    (tmp_path / "src/a.md").write_bytes("é one".encode())
    stream_ingest(spark, src, table, ckpt, "*.md").awaitTermination(60)
    (tmp_path / "src/b.md").write_bytes(b"caf\xe9")
    (tmp_path / "src/c.bin").write_bytes(b"x")
    stream_ingest(spark, src, table, ckpt, "*.md").awaitTermination(60)
    stream_ingest(spark, src, table, ckpt, "*.md").awaitTermination(60)
    assert sorted(r.text for r in current_docs(spark, table).collect()) == ["café", "é one"]
    assert spark.read.parquet(table).count() == 2


def test_rows_of_a_result_are_numbered_without_a_join_on_one_key(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    rows = R.result_rows(df, ["k"])
    assert [(r.row_no, r.row_json) for r in rows.orderBy("row_no").limit(2).collect()] == [(1, '{"k":0}'), (2, '{"k":1}')]
    assert str(rows._jdf.queryExecution().optimizedPlan().toString()).count("Join ") == 1  # with the starts of the tasks
