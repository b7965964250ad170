import random

from pyspark.sql import functions as F

from attestra.operators import typed as T
from attestra.sources import blocks as B
from attestra.sources import delimited, grid, html, web

MARKDOWN = """---
title: "Ideas: one"
source: a
source: b
---
# Top ##
intro line
second line

## Part
- item one
- item two

| Name | |
|---|---|
| bolt | 4 |
| nut | |
note

```
# not a heading

code | x
```
### Deep
1) first"""


def docs(spark, text, key="d"):
    return spark.createDataFrame([(key, text)], "doc_id string, text string")


def test_markdown_blocks(spark):
    got = {r.anchor: r for r in B.segment_text(docs(spark, MARKDOWN)).collect()}
    assert [got[a].kind for a in ("L6", "L7-L8", "L10", "L11-L12", "L14-L18", "L20-L24", "L25", "L26")] == [
        "heading", "para", "heading", "list", "table_row", "para", "heading", "list",
    ]
    assert got["L6"].text == "Top"
    assert got["L14-L18"].text == "Name | \nName: bolt | col2: 4\nName: nut"
    assert got["L26"].section == "Top > Part > Deep"
    assert [r.seq for r in sorted(got.values(), key=lambda r: r.seq)] == list(range(8))


def test_plain_text_has_no_headings(spark):
    kinds = {r.kind for r in B.segment_text(docs(spark, MARKDOWN), markdown=False).collect()}
    assert "heading" not in kinds


def test_front_matter(spark):
    cases = [(MARKDOWN, 5, {"title": "Ideas: one", "source": "b"}), ("---\na: b\nbody", 0, {}), ("x\n---", 0, {}), ("", 0, {})]
    for text, skip, meta in cases:
        fm = docs(spark, text).select(B.front_matter(F.col("text")).alias("f")).first().f
        assert (fm.skip, fm.meta) == (skip, meta)
    late = "---\n" + "a: b\n" * 70 + "---\n"
    assert docs(spark, late).select(B.front_matter(F.col("text")).alias("f")).first().f.skip == 0


def test_pipe_cells(spark):
    cells = B.pipe_table_cells(B.segment_text(docs(spark, MARKDOWN))).collect()
    assert {(r.r, r.c): r.v for r in cells} == {(1, 1): "Name", (1, 2): "", (2, 1): "bolt", (2, 2): "4", (3, 1): "nut", (3, 2): ""}


def test_delimited(spark):
    text = 'a;b;\n\n1;"x; ""y""\nz";3;4\n;;\n2\n'
    rows = {r.r: r for r in delimited.read_delimited(docs(spark, text)).collect()}
    assert rows[1].header == ["a", "b", "col3"]
    assert rows[2].fitted == ["1", 'x; "y"\nz', "3"] and rows[3].fitted == ["2", "", ""]
    assert delimited.empty_files(docs(spark, " \n")).count() == 1


def cells(spark):
    rows = [
        (1, 1, "Results", "s"), (2, 1, "in mm", "s"), (4, 2, "ID", "s"), (4, 4, "Width", "s"), (5, 2, "a1", "s"), (5, 3, "ok", "s"), (5, 4, "4.5", "f"),
        (6, 2, "a2", "s"), (6, 4, "n/a", "s"), (7, 2, " ", "s"), (9, 6, "", "s"),
    ]
    notes = [(1, 1, "only text", "s"), (2, 1, "more", "s")]
    data = [("d", "Main", r, c, v, k, None) for r, c, v, k in rows] + [("d", "My notes", r, c, v, k, None) for r, c, v, k in notes]
    data.append(("d", "Main", 6, 3, None, None, "=A1"))
    return spark.createDataFrame(data, "doc_id string, sheet string, r int, c int, v string, kind string, formula string")


def test_grid(spark):
    c = cells(spark)
    heads = {r.sheet: r.header_row for r in grid.detect_header(c).collect()}
    assert heads == {"Main": 4, "My notes": None}
    given = spark.createDataFrame([("d", "My notes", 1)], "doc_id string, sheet string, header_row int")
    assert {r.sheet: r.header_row for r in grid.detect_header(c, given).collect()}["My notes"] == 1
    got = {r.anchor: r.text for r in grid.sheet_blocks(c, grid.detect_header(c)).collect()}
    assert got["Main!B5:D5"] == "ID: a1 | col_C: ok | Width: 4.5"
    assert got["Main!A1:D1"] == "Results"
    assert got["Main!A1:D6"].startswith("Main has 2 rows of data in 3 columns, header in row 4: ID, col_C, Width. Not calculated yet: 1 formula")
    assert got["'My notes'!A1:A2"].endswith("without a header row: col_A.")


def test_infer_types(spark):
    def column(values):
        rows = [("d", "s", i, 1, v, k) for i, (v, k) in enumerate(values)]
        df = spark.createDataFrame(rows, "doc_id string, sheet string, r int, c int, v string, kind string")
        r = T.infer_types(df).first()
        return r.type, r.notes

    num = [(str(i), "i") for i in range(18)]
    assert column(num)[0] == "BIGINT"
    assert column([*num, ("1.5", "f"), ("soon", "s")]) == ("DOUBLE", "no number, left empty: 1 values such as 'soon'")
    assert column([*num, ("true", "b"), ("n/a", "s")]) == (
        "DOUBLE", "read as missing: 1 times 'n/a'; no number, left empty: 1 values such as ",
    )
    assert column([("true", "b")])[0] == "BOOLEAN"
    assert column([("-", "s"), (None, None)])[0] == "VARCHAR"
    assert column([("2024-01-01 00:00:00", "t"), ("2024-01-02T00:00:00", "t")])[0] == "DATE"
    assert column([("2024-01-01 10:00:00", "t")])[0] == "TIMESTAMP"
    assert column([("2024-01-01", "d"), ("2024-01-01 10:00:00", "t")])[0] == "DATE"
    assert column([("1", "i"), ("x", "s")])[0] == "VARCHAR"


def test_unique_names_skip_given_ones(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(["a_2", "a", "a", "a", "b"])], "t int, pos int, ident string")
    got = sorted(T.unique_names(df, ["t"], "pos").collect(), key=lambda r: r.pos)
    assert [r.unique_name for r in got] == ["a_2", "a", "a_3", "a_4", "b"]


def test_html(spark):
    page = (
        "<html><head><title>A &amp; B</title></head><body><nav><li>menu</li></nav><!-- x --><h1>Head</h1><p>one<br>two &#233;&#x41;"
        "<script>var a='<p>'</script><table><tr><th>K</th><th>V</th></tr><tr><td>a</td><td>1</td></tr></table>"
        '<a href="../c?q=1#f">x</a><a HREF="//h/d">y</a><a href="https://other/z">z</a><a href="?p=2">q</a></body></html>'
    )
    df = spark.createDataFrame([(1, "http://h/a/b", page)], "page_id int, url string, html string")
    got = [(r.kind, r.text) for r in html.html_blocks(df).orderBy("seq").collect()]
    assert got[:5] == [("heading", "Head"), ("para", "one"), ("para", "two éA"), ("table_row", "K | V"), ("table_row", "a | 1")]
    assert [r.url for r in html.page_links(df).orderBy("pos").collect()] == ["http://h/c?q=1", "http://h/d", "http://h/a/b?p=2"]
    assert {(r.r, r.c): r.v for r in html.html_table_cells(df).collect()} == {(1, 1): "K", (1, 2): "V", (2, 1): "a", (2, 2): "1"}
    assert df.select(html.html_title(F.col("html"))).first()[0] == "A & B"
    bare = spark.createDataFrame([(2, "u", "<body><nav>x</nav></body>")], "page_id int, url string, html string")
    assert html.empty_pages(bare.unionByName(df)).count() == 1


def test_sources_and_robots(spark):
    paths = ["a.md", "x/.git/b.md", "outputs/c.md", "d.exe", "x/outputs.md", "node_modules/y/z.txt", "q/.raw/h.html"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = web.select_sources(df, exclude=["outputs/**", "node_modules/**", "**/.raw/**"])
    assert sorted(r.path for r in kept.collect()) == ["a.md", "x/outputs.md"]
    urls = spark.createDataFrame([("http://a/x/1",), ("http://a/y",), ("http://b/x/1",)], "url string")
    rules = spark.createDataFrame([("a", "/x/1", True, 1), ("a", "/x", False, 2), ("a", "/", False, 3)], "host string, path_prefix string, allow boolean, ord int")
    assert {r.url: r.allowed for r in web.robots_filter(urls, rules).collect()} == {"http://a/x/1": True, "http://a/y": False, "http://b/x/1": True}


def test_reading_order_and_wrapping(spark):
    rows = [("d", 1, 1, True, 90, 0, 0, 0, "Title"), ("d", 1, 2, False, 50, 10, 0, 1, "right"), ("d", 1, 3, False, 50, 0, 0, 0, "left"), ("d", 2, 1, False, 0, 0, 0, 0, " ")]
    df = spark.createDataFrame(rows, "doc_id string, slide int, shape int, is_title boolean, top int, left int, para int, level int, text string")
    got = {r.slide: r for r in B.reading_order(df).collect()}
    assert got[1].text == "Title\n- left\n  - right" and got[2].text == "(slide 2 has no text)" and got[2].section == "Slide 2"
    assert docs(spark, "Statu\ns of\nit Targe\nt").select(B.rejoin_wrapped(F.col("text"))).first()[0] == "Status of it Target"


def test_unique_names_of_wide_and_of_clashing_tables(spark):
    """16,384 equal names in one table; names that look like given ones, against trying every number in turn."""
    wide = spark.range(16384).select(F.lit(0).alias("t"), F.col("id").alias("pos"), F.lit("a").alias("ident"))
    top = T.unique_names(wide, ["t"], "pos").agg(F.countDistinct("unique_name").alias("n"), F.max_by("unique_name", "pos").alias("last")).first()
    assert tuple(top) == (16384, "a_16384")
    rng = random.Random(3)
    rows = [(t, i, rng.choice(["a", "a_2", "a_3", "a_2_2", "b"])) for t in range(20) for i in range(rng.randint(1, 12))]
    got = {(r.t, r.pos): r.unique_name for r in T.unique_names(spark.createDataFrame(rows, "t int, pos int, ident string"), ["t"], "pos").collect()}
    for t in range(20):
        held = []
        for _, i, n in (r for r in rows if r[0] == t):
            held.append(n if n not in held else next(f"{n}_{k}" for k in range(2, 99) if f"{n}_{k}" not in held))
            assert got[t, i] == held[-1]
    assert len(got) == len(rows)


def test_table_body_lies_below_the_header(spark):
    """Titles, the header and blank margins are no part of a table; a sheet without a header, or of blanks, has none."""
    rows = [
        ("a", 1, 1, "Title", "s"), ("a", 3, 1, "k", "s"), ("a", 3, 2, "v", "s"), ("a", 4, 1, "1", "i"), ("a", 4, 2, "2", "i"), ("a", 9, 9, " ", "s"),
        ("b", 1, 1, "1", "i"), ("b", 2, 1, "2", "i"), ("c", 1, 1, " ", "s"),
    ]
    cells = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, sheet string, r int, c int, v string, kind string")
    assert sorted((x.sheet, x.r, x.c) for x in grid.table_body(cells).collect()) == [("a", 4, 1), ("a", 4, 2)]
    assert grid.table_body(cells.limit(0)).count() == 0
    given = spark.createDataFrame([("d", "b", 1)], "doc_id string, sheet string, header_row long")
    assert [(x.sheet, x.r) for x in grid.table_body(cells, given).collect()] == [("b", 2)]
