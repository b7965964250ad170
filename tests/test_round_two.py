"""Cases that were once wrong: guards, kept rows, exact dates, long brackets, repeated edits, extreme numbers."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import numbers as N
from attestra.operators import citations as C
from attestra.operators import edits as E
from attestra.operators import results as R
from attestra.operators.verify import claim_figures
from attestra.scale import rank_within


@pytest.mark.parametrize(
    "sql",
    [
        "execute immediate 'drop view secret'", "/* x */ drop view secret", "select * from secret", "from t insert into t select *", "select * from t where a in (select id from secret)",
        "select * from parquet.`/tmp`", "with secret as (select * from t) select * from secret", "select 1; select 2", "with q as (select * from secret) select * from q",
        "select reflect('java.lang.System', 'gc')", "begin select 1; end", "describe secret", "-- x\ncreate view k as select 1", "table secret", "explain select * from t",
    ],
)
def test_only_reads_of_the_named_tables(spark, sql):
    spark.range(3).createOrReplaceTempView("secret")
    with pytest.raises(R.SqlRefused):
        R.run_sql(spark, sql, {"t": spark.range(5).select(F.col("id").alias("a"))})
    assert spark.catalog.tableExists("secret") and not spark.catalog.tableExists("t")


def test_reads_are_run(spark):
    t = {"t": spark.range(5).select(F.col("id").alias("a"))}
    for sql, n in (("with q as (select * from t) select * from q where a in (select a from t)", 5), ("select 'drop view x;' as d from t;", 5), ("describe t", 1), ("summarize t", 1)):
        assert R.run_sql(spark, sql, t).count() == n


def test_saved_results_keep_all_rows(spark, tmp_path):
    df = spark.range(1500).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("n"))
    numbers = [R.save_result(spark, df, ["k"], "select k from t", {"t": "t.csv"}, f"file://{tmp_path}") for _ in range(2)]
    numbers.append(R.save_result(spark, df, ["k"], "select k from t", {"t": "t.csv"}, f"file://{tmp_path}", max_rows=10))
    assert numbers == [1, 2, 3]
    for number, kept, more in ((1, 1500, False), (2, 1500, False), (3, 10, True)):
        head, rows = R.read_result(spark, f"file://{tmp_path}", number, shown=None)
        assert rows.count() == kept and head.select("row_count", "more").first() == (1500, more)
    assert rows.filter("row_no = 7").first()["row_json"] == '{"k":6,"n":null}'


def test_ranks_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 1), (None, 0)], "k string, v int")
    assert sorted((r["k"] or "", r["v"], r["rn"]) for r in rank_within(df, ["k"], ["v"]).collect()) == [("", 0, 1), ("", 1, 2), ("a", 1, 1), ("a", 2, 2)]


def test_long_brackets(spark):
    texts = ["[@" + "x" * 100_000 + "]", "[@a \"" + "q;" * 50_000 + "\"; @b]", "[@" + "'a b'" * 20_000 + "]", "[@media " + "y " * 50_000 + "]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(C.parse_citations(F.col("t")).alias("c"))
    got = [[(x["ok"], (x["ref"] or "")[:1]) for x in r["c"]] for r in df.collect()]
    assert got == [[(True, "x")], [(True, "a"), (True, "b")], [(True, "'")], [(False, "")]]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Sales ran 5 March 2024-10 March 2024.", [20240305.0, 20240310.0]), ("the 9 February 2026-dated report", [20260209.0]), ("On 2024-02-30 and 2024-02-29", [20240229.0, 2024.0, 30.0]),
        ("7 on 1 May 2020, 8", [20200501.0, 7.0, 8.0]),
    ],
)
def test_dates_beside_hyphens(spark, text, want):
    df = claim_figures(spark.createDataFrame([(text,)], "sentence string"))
    got = [f["value"] for f in df.first()["figures"]]
    assert got[: len([w for w in want if w > 1e6])] == [w for w in want if w > 1e6]
    if "02-30" not in text:
        assert got == want


def test_the_last_edit_of_a_cell_holds(spark):
    cells = spark.createDataFrame([("b", "S", 1, 1, "old", "s", "=A2"), ("b", "S", 2, 1, "x", "s", None)], "doc_id string, sheet string, r int, c int, v string, kind string, formula string")
    edits = spark.createDataFrame([("b", "S!A1", "1", 1), ("b", "A1", "2.5", 2), ("b", "B7", "new", 3), ("b", "T!A1", "no", 4)], "doc_id string, ref string, value string, n int")
    after, changes, refused = E.apply_cell_edits(cells, edits, default_sheet="S", order="n")
    got = {(r["r"], r["c"]): (r["v"], r["kind"], r["formula"]) for r in after.collect()}
    assert got == {(1, 1): ("2.5", "f", None), (2, 1): ("x", "s", None), (7, 2): ("new", "s", None)}
    assert after.columns[-3:] == ["v", "kind", "formula"] and changes.count() == 2
    assert [r["reason"] for r in refused.collect()] == ["no such sheet"]


def test_extreme_numbers_as_text(spark):
    values = [1e30, 1e-12, float("nan"), float("inf"), 0.1, 148250.0, 1e15, -2.5e-7]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(N.format_value(F.col("x"), "double").alias("t"))
    got = [r["t"] for r in df.collect()]
    assert [float(t) for t in got[:2]] == values[:2] and got[2:6] == ["nan", "inf", "0.1", "148250"] and [float(t) for t in got[6:]] == values[6:]


def test_words_start_with_their_stem_but_its_last_letter():
    import itertools

    from attestra.functions.stem import porter

    parts = ["", "a", "t", "go", "cat", "hop", "trad", "relat", "y", "ies", "ing", "ed", "s", "ational", "iveness", "ation", "fulli", "ee", "ll"]
    for bits in itertools.product(parts, repeat=3):
        word = "".join(bits)
        if len(word) > 2:
            assert word.startswith(porter(word)[:-1]), word


def test_stems_of_what_is_no_word(spark):
    from attestra.functions.stem import stem

    df = spark.createDataFrame([("running",), ("2024s",), ("as",), ("été",), (None,)], "t string")
    assert [r[0] for r in df.select(stem(F.col("t"))).collect()] == ["run", "2024s", "as", "été", None]


def test_character_references(spark):
    from attestra.sources.html import unescape

    texts = ["caf&eacute; &mdash; 5&euro;&hellip; &amp;lt; &#233;&#xe9;", "a &unknown; b&nbsp;c &", None, "&copy;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(unescape(F.col("t")))
    assert [r[0] for r in df.collect()] == ["café — 5€… &lt; éé", "a &unknown; b c &", None, "©"]


def test_every_asked_reference_is_answered(spark):
    from attestra.operators.refs import read_refs

    docs = spark.createDataFrame([("a", "A", "a.md", "md")], "doc_id string, title string, path string, doc_type string")
    blocks = spark.createDataFrame([("a", 0, "L1", "para", "", "one", 1)], "doc_id string, seq int, anchor string, kind string, section string, text string, level int")
    asked = spark.createDataFrame([("a#L1",), ("a#L9",), ("b#L1",), ("Bad Ref",), ("calc:1",), ("calc:2",)], "ref string")
    results = spark.createDataFrame([(1, "select 1", ["t.csv"])], "result_id int, sql string, source_files array<string>")
    rows = spark.createDataFrame([(1, i, f'{{"n":{i}}}') for i in range(1, 40)], "result_id int, row_no int, row_json string")
    got = {r["ref"]: r["text"] for r in read_refs(asked, docs, blocks, results=results, rows=rows).collect()}
    assert set(got) == {r["ref"] for r in asked.collect()}
    assert got["a#L1"] == "[L1] one" and got["a#L9"] == "(unresolved: anchor not found)" and got["calc:2"] == "(unresolved: no such result)"
    assert got["calc:1"].startswith('SQL: select 1\nFiles: t.csv\n{"n":1}\n') and got["calc:1"].endswith('{"n":25}')
