"""Evidence as rows: figures and quotes against the rules in plain form, what runs over ends, and results of any size."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attestra.functions.numbers import evidence_numbers, numbers_match
from attestra.operators import evidence as E
from attestra.operators import verify as V

FIGURE = "ref string, value double, decimals int, is_percent boolean, trailing_zeros int, approx boolean"


def test_figures_meet_values_as_the_rule_says(spark):
    rng = random.Random(2)
    near = lambda x: x * (1 + rng.choice([0, 3e-10, 9e-10, -9e-10, 1.2e-9, 4e-9, 1e-6]))
    base = [0.0, 1e-13, 5e-4, 1e-3, 0.37, 1.005, 2.5, 14.2, 275.0, 41200.0, 93640.4, 1.5e6, 2.65e6, 7e15, 1e22, -3.5, -275.0, 37.0, 0.375]
    values = [("r" + str(k % 40), near(rng.choice(base)) + rng.choice([0, 0, 0.004, 0.5, 1e-12, 40, -0.05])) for k in range(400)]
    claims = []
    for _ in range(400):
        x, decimals = near(rng.choice(base)), rng.choice([0, 0, 1, 2, 3, 15])
        x = round(x, decimals) if rng.random() < 0.8 else x
        if rng.random() < 0.2:
            x = rng.choice(values)[1]
        percent = rng.random() < 0.3
        claims.append(("r" + str(rng.randrange(40)), x * 100 if percent and rng.random() < 0.5 else x, decimals, percent, rng.choice([0, 1, 2, 5]), rng.random() < 0.5))
    c = spark.createDataFrame(claims, FIGURE).distinct()
    v = spark.createDataFrame(values, "ref string, value double")
    pool = v.groupBy("ref").agg(F.collect_list("value").alias("pool"))
    rule = c.join(pool, "ref").filter(numbers_match(F.struct(*E.FIGURE_KEY), F.col("pool"))).select("ref", *E.FIGURE_KEY)
    want = sorted(map(str, rule.collect()))
    assert sorted(map(str, E.figures_found(c, v).select("ref", *E.FIGURE_KEY).collect())) == want
    assert 50 < len(want) < c.count() - 50


def test_no_value_no_claim(spark):
    none = spark.createDataFrame([], "ref string, value double")
    claims = spark.createDataFrame([("r", 1.0, 0, False, 0, False)], FIGURE)
    odd = spark.createDataFrame([("r", float("inf")), ("r", float("nan")), ("r", None), (None, 1.0)], "ref string, value double")
    assert E.figures_found(claims, none).count() == 0 and E.figures_found(claims.limit(0), odd).count() == 0
    assert E.figures_found(claims, odd).count() == 0


def plain_quote(quote, text):
    norm = lambda t: re.sub(r"\s+", " ", t.translate(str.maketrans("’‘“”–—\xa0", "''\"\"-- "))).strip().lower()
    text, at = norm(text), 0
    for part in re.split(r"\s*(?:\.\.\.|…|\[\.\.\.\])\s*", quote):
        part = norm(part).strip(" .,;:")
        if part:
            at = text.find(part, at)
            if at < 0:
                return False
            at += len(part)
    return True


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_over_the_ends_of_pieces(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "ba", "aba", "Frame", "7", "“seven”", "stopped", "x.", "é", "per cent"]
    pieces, quotes = [], []
    for r in range(40):
        ref = f"r{r}"
        cuts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 8]))) for _ in range(rng.randint(1, 12))]
        pieces += [(ref, k, rng.choice(["", " ", "\t"]) + t.replace(" ", rng.choice([" ", "  ", "\n"]))) for k, t in enumerate(cuts)]
        whole = " ".join(cuts)
        for _ in range(25):
            i, j = sorted(rng.randint(0, len(whole)) for _ in range(2))
            k, m = sorted(rng.randint(0, len(whole)) for _ in range(2))
            quotes.append((ref, rng.choice([whole[i:j], whole[i:j].upper(), whole[i:j] + " … " + whole[k:m], whole[i : i + 3] + "..." + whole[k : k + 5] + " [...] " + whole[m : m + 2], whole[i:j] + "zz", whole])))
        quotes += [(ref, "…"), (ref, ""), (ref, "a … a … a … a"), (ref, "nowhere here at all")]
    texts = {}
    for ref, _, t in sorted(pieces):
        texts.setdefault(ref, [])
    for ref, _, t in pieces:
        texts[ref].append(t)
    frame = spark.createDataFrame(pieces, "ref string, pos long, text string")
    got = {(r.ref, r.quote): r.found for r in E.quotes_found(spark.createDataFrame(quotes, "ref string, quote string"), frame).collect()}
    want = {(ref, q): plain_quote(q, "\n".join(texts[ref])) for ref, q in quotes}
    assert got == want and 0.3 < sum(want.values()) / len(want) < 0.95


def test_quotes_of_nothing(spark):
    quotes = spark.createDataFrame([("r", "a b"), ("r", "...")], "ref string, quote string")
    none = spark.createDataFrame([], "ref string, pos long, text string")
    assert sorted((r.quote, r.found) for r in E.quotes_found(quotes, none).collect()) == [("...", True), ("a b", False)]
    assert E.quotes_found(quotes.limit(0), none).count() == 0


def test_values_over_the_ends_of_blocks(spark):
    """Cut anywhere between words, a text states the same values as in one piece."""
    text = "On 3 April 2025 it was EUR 275 m then 12 bn or 5 k and March 4 , 2024 came 14 Sept 2023 with six of 9 at 2024-05-06 and 7 %"
    words = text.split(" ")
    rng = random.Random(3)
    blocks, docs, refs = [], [], []
    for k in range(40):
        cuts = sorted(rng.sample(range(1, len(words)), rng.choice([0, 1, 3, 10, len(words) - 1])))
        parts = [" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)])]
        blocks += [(f"d{k}", i, f"p{i + 1}", "para", "", t) for i, t in enumerate(parts)]
        docs.append((f"d{k}", f"x/d{k}.txt", "t"))
        refs.append((f"d{k}",))
    frame = spark.createDataFrame(blocks, "doc_id string, seq int, anchor string, kind string, section string, text string")
    results = spark.createDataFrame([], "result_id int, sql string, columns array<string>")
    rows = spark.createDataFrame([], "result_id int, row_no int, row_json string")
    ev = E.evidence(spark.createDataFrame(refs, "ref string"), spark.createDataFrame(docs, "doc_id string, path string, title string"), frame, results, rows)
    got = {r.ref: sorted(r.v) for r in ev.values.groupBy("ref").agg(F.collect_set("value").alias("v")).collect()}
    joined = {f"d{k}": "\n".join(b[5] for b in blocks if b[0] == f"d{k}") for k in range(40)}
    whole = spark.createDataFrame(list(joined.items()), "ref string, text string").select("ref", F.array_sort(F.array_distinct(evidence_numbers(F.col("text")))).alias("v"))
    assert got == {r.ref: r.v for r in whole.collect()}
    assert {r.error for r in ev.refs.collect()} == {None}


def test_a_result_of_more_than_a_million_rows(spark):
    """Its cells stay rows: no plan gathers them, and figures and quotes are still found."""
    n = 1_100_000
    rows = spark.range(n).selectExpr("1 as result_id", "cast(id + 1 as int) as row_no", """concat('{"m":', id * 3 + 0.25, ',"label":"item ', id, ' of many"}') as row_json""")
    results = spark.createDataFrame([(1, "select m, label from t", ["m", "label"])], "result_id int, sql string, columns array<string>")
    drafts = spark.createDataFrame(
        [(1, "The mean was 2,999,997.25 in the end [@calc:1]."), (2, "The mean was 2,999,998 in the end [@calc:1]."), (3, 'See [@calc:1 "item 999999 of many | item 1000000 of"].'), (4, 'See [@calc:1 "item 7 of many | item 9 of"].')],
        "draft_id int, text string",
    )
    checked = V.verify(drafts, None, None, results, rows)
    assert sorted((r.draft_id, r.code) for r in checked.issues().collect()) == [(2, "figure-mismatch"), (4, "bad-quote")]
    plan = checked.evidence.values._jdf.queryExecution().toString() + E.figures_found(checked.stated.select(F.lit("calc:1").alias("ref"), F.explode("figures").alias("f")).select("ref", "f.*"), checked.evidence.values)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


@pytest.mark.parametrize("few", [10_000, 3, 0])
def test_quotes_are_found_by_few_and_by_many_keys(spark, monkeypatch, few):
    monkeypatch.setattr(E, "FEW", few)
    pieces = spark.createDataFrame([("r", 0, "the old mill"), ("r", 1, "stands by a river"), ("s", 0, "nothing here")], "ref string, pos long, text string")
    told = {"mill stands by": True, "old mi … by a riv": True, "river … mill": False, "ds b": True, "zz": False, "the old mill stands by a river": True}
    quoted = spark.createDataFrame([("r", q) for q in told] + [("s", "thing")], "ref string, quote string")
    got = {(r.ref, r.quote): r.found for r in E.quotes_found(quoted, pieces).collect()}
    assert got == {**{("r", q): f for q, f in told.items()}, ("s", "thing"): True}


def test_only_wanted_keys_leave_a_piece(spark):
    held = spark.createDataFrame([("r", i, "a b c d e f") for i in range(50)] + [("r", 50, "x y z")], "ref string, pos long, t string")
    wanted = spark.createDataFrame([("r", "y"), ("r", "q")], "ref string, key string")
    sizes = spark.createDataFrame([("r", [1])], "ref string, sizes array<int>")
    out = E._keyed_pieces(held, wanted, sizes, F.split("t", " "), ["ref", "pos"])
    assert [tuple(r) for r in out.collect()] == [("r", 50, "y")]
