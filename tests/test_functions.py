import pytest
from pyspark.sql import functions as F

from attestra.functions import anchors as A
from attestra.functions import numbers as N
from attestra.functions import text as X
from attestra.functions.stem import porter
from tests.spec import half_up


def one(spark, value, *fns):
    df = spark.createDataFrame([(value,)], "t string")
    row = df.select(*[fn(F.col("t")).alias(f"c{i}") for i, fn in enumerate(fns)]).first()
    return row[0] if len(fns) == 1 else tuple(row)


@pytest.mark.parametrize(
    "text, values",
    [
        ("QX-31 broke after 12,500 runs in Z3", [12500.0]),
        ("qRR-70 is $8.15, 62% of all", [8.15, 62.0]),
        ("263k runs, 2.4M lots, 3bn", [263000.0, 2400000.0, 3e9]),
        ("2025-04-03", [2025.0]),
        ("é5 and 5 m and 7 mm and v1.2.3", [5000000.0, 7.0]),
        ("1,234.50 then 12,34", [1234.5, 12.0, 34.0]),
        ("", []),
    ],
)
def test_find_numbers(spark, text, values):
    found = [n.value for n in one(spark, text, N.find_numbers)]
    assert found == values


def test_figure_fields(spark):
    a, b, c = one(spark, "about $240,000 or 11.60 or 148.5k", N.find_numbers)
    assert (a.text, a.decimals, a.trailing_zeros, a.approx) == ("$240,000", 0, 4, True)
    assert (b.decimals, b.trailing_zeros, b.approx) == (2, 0, False)
    assert (c.value, c.decimals, c.trailing_zeros, c.approx) == (148500.0, 0, 2, True)


@pytest.mark.parametrize(
    "claim, evidence, expected",
    [
        ("52,417", [52417.0], True),
        ("19", [18.7], True),
        ("19.5", [18.7], False),
        ("230,000", [227911.4], False),
        ("about 230,000", [227911.4], True),
        ("228k", [227911.4], True),
        ("71.35%", [0.7135], True),
        ("71.35%", [71.35], True),
        ("71.35%", [0.7235], False),
        ("1.01", [1.005], True),
        ("0.3", [0.25], True),
        ("5", [], False),
    ],
)
def test_numbers_match(spark, claim, evidence, expected):
    df = spark.createDataFrame([(claim, evidence)], "t string, e array<double>")
    got = df.select(N.find_numbers(F.col("t"))[0].alias("n"), "e").select(N.numbers_match(F.col("n"), F.col("e"))).first()[0]
    assert got is expected


def test_half_up_equals_decimal(spark):
    values = [(v / 1000 + 0.0005, d) for v in range(0, 3000, 37) for d in (0, 1, 2, 3)]
    df = spark.createDataFrame(values, "x double, d int")
    for r in df.select("x", "d", N.round_half_up(F.col("x"), F.col("d")).alias("y")).collect():
        assert r.y == half_up(r.x, r.d)


def test_dates_words_counts(spark):
    text = "On 3 April 2025 (2025-04-03, Apr. 3rd, 2025) not 2025-02-30 nor 31 June 2020"
    assert [d.value for d in one(spark, text, N.find_dates)] == [20250403.0] * 3
    assert one(spark, "Seven runs, twenty-five and Nine", N.word_numbers) == [7.0, 5.0, 9.0]
    words = [w.text for w in one(spark, "six of the eight; one of two; 5 out of twelve; ten of 11", N.count_words)]
    assert words == ["six", "eight", "two", "twelve", "ten"]
    assert one(spark, "where x >= 80000 and y < 1.5 and z = 'a7'", N.sql_numbers) == [80000.0, 1.5]


def test_text(spark):
    assert one(spark, "Kế hoạch mở rộng xưởng Đồng Nai", X.slugify) == "ke-hoach-mo-rong-xuong-dong-nai"
    assert one(spark, "½ ﬁne™ ***", X.slugify) == "12-finetm"
    assert one(spark, "!!!", X.slugify) == "x"
    assert one(spark, "2 cols", X.sql_ident) == "c_2_cols"
    assert one(spark, "XƯỞNG é́", X.fold) == "xuong e"
    assert one(spark, "“A — b”  c’s", X.norm_quote) == "\"a - b\" c's"
    t = one(spark, "aaaa\nbbbb\ncccccccc", lambda c: X.truncate_text(c, 12))
    assert (t.text, t.cut) == ("aaaa\nbbbb", True)
    t = one(spark, "a\nbbbbbbbbbbbbbbbb", lambda c: X.truncate_text(c, 10))
    assert t.text == "a\nbbbbbbbb"


def test_decode(spark):
    rows = [(b"\xef\xbb\xbfhi", "hi"), ("é".encode(), "é"), (b"caf\xe9 \x93q\x94", "café “q”"), (b"\x81\xe9", "\x81é")]
    df = spark.createDataFrame(rows, "b binary, want string")
    for r in df.select(X.decode_text(F.col("b")).alias("got"), "want").collect():
        assert r.got == r.want


def test_values(spark):
    df = spark.createDataFrame([(0.1, 0.45), (93640.0, 1.0), (1e-7, 0.123)], "x double, y double")
    got = df.select(
        N.format_value(F.col("x"), "double"), N.format_value(F.col("y"), "double", F.lit("0%")), N.display_number(F.col("x"))
    ).collect()
    assert [tuple(r) for r in got] == [("0.1", "45%", "0.1"), ("93640", "100%", "93640"), ("0.0000001", "12.3%", "1e-07")]


def test_globs(spark):
    df = spark.createDataFrame([("a/b.md",), ("a/~$x.docx",), ("ab.md",)], "p string")
    hits = lambda g: sorted(r.p for r in df.filter(F.col("p").rlike(X.glob_to_regex(g))).collect())
    assert hits("a/*.md") == ["a/b.md"]
    assert hits("**/~$*") == ["a/~$x.docx"]
    assert hits("a[!/]*.md") == ["ab.md"]


def test_anchors(spark):
    cells = one(spark, "'My ''x'' sheet'!$B9:D5", A.parse_cells)
    assert (cells.sheet, cells.lo, cells.hi) == ("My 'x' sheet", 5, 9)
    assert one(spark, "L10-R14", A.parse_lines) is None
    assert one(spark, "My sheet", A.sheet_ref) == "'My sheet'"
    p = one(spark, "@launch#t1.r2", A.parse_ref)
    assert (p.doc, p.anchor, p.ok) == ("launch", "t1.r2", True)
    assert one(spark, "Launch day", A.parse_ref).ok is False


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
        ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("formaliti", "formal"), ("triplicate", "triplic"),
        ("hopeful", "hope"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("licensed", "licens"), ("sky", "sky"),
        ("electrical", "electr"), ("replacement", "replac"), ("rate", "rate"), ("roll", "roll"),
    ],
)
def test_porter_published_pairs(word, stem):
    assert porter(word) == stem


def test_a_slug_reads_its_words_once(spark):
    df = spark.createDataFrame([("7 ﬁne Straße",), ("plain",), ("…",), ("",), (None,)], "t string")
    named = df.select(X.sql_ident(F.col("t")).alias("i"), X.slugify(F.col("t"), "-", 5).alias("s"))
    assert [tuple(r) for r in named.collect()] == [("c_7_fine_strae", "7-fin"), ("plain", "plain"), ("x", "x"), ("x", "x"), (None, None)]
    plan = df.select(X.sql_ident(F.col("t")).alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]+") == 1
