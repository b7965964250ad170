import random

from pyspark.sql import functions as F

from attestra.llm import personal
from tests.llm import plain

ODD = [
    None, "", "a@b.c", "x..y@a-b.co.uk.", "a@b", "a@@b.c x_y%+z@q.r.s", "m@n.o_p@q.r", "1.2.3.4", "300.1.2.3 1.2.3.4.5.6.7.8", "007.0.00.255 1.2.3.256",
    "4111 1111 1111 1111 4111-1111-1111-1112", "41111111111111111111111", "+1 (017) 555-7713 a", "+12 +123456789 +1234567890 x", "+1.2.3.4 (1.2.3.4)", "é日本 a@b.de 日 10.0.0.1 \U0001f600 +49 30 1234567",
    "a" * 30000, "a." * 20000 + "@", "a@" + "b." * 20000 + "c", "1" * 30000, "1 " * 20000, "+" * 20000 + "1", "+1" + "(" * 20000, "5 a 6", "12 3", "x@y.z\nw@v.u",
]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, gen int, match string")


def test_base_equals_plain_search(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "+1 (017) 555-7713", "4111 1111 1111 1111", "10.0.0.1", "999.1.1.1", " ", "x", "é", "-", ".", "7", "@", "+", "\n", "4111111111111112", "12345678901"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    rows = {r["doc_id"]: r for r in personal.report(_docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r, want = rows[i], plain.personal_row(i, t)
        assert (r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want[:6], (i, t)
        assert set(filter(None, want[6].split(","))) <= set(r["spans"].split(","))


def test_repeats_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) + r["spans"] for r in personal.report(df).collect()) == ["1email:0:5", "1email:0:5", "Noneemail:0:5"]
    assert personal.report(df.limit(0)).count() == 0


def test_trees_add_what_looks_like_confirmed_spans(spark):
    rng = random.Random(5)
    texts = [f"call +1 (0{rng.randint(10, 99)}) 555-{rng.randint(1000, 9999)} or run {rng.randint(1, 99)} {rng.randint(1, 9)}-{rng.randint(1, 9)} times" for _ in range(300)]
    found = personal.report(_docs(spark, texts + ["mail me: joe (at) example (dot) com"])).collect()
    assert all("phone:5:" in r["spans"] for r in found if r["doc_id"] < 300)
    assert all(len(r["spans"].split(",")) == 1 for r in found)


def test_frequent_kinds_that_the_base_misses_are_added(spark):
    """Many phones without a sign and written-out addresses beside what the base knows; dates, versions and codes stay out."""
    rng = random.Random(8)
    phone = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    texts, want = [], []
    for i in range(600):
        made = [f"x +1 {phone()} y", f"thus {phone()} z", f"see joe{i} (at) example (dot) com. And", f"mail ann{i}@example.com", f"on 2024-0{i % 9 + 1}-1{i % 9}", f"version {i % 9}.{i % 7}.10", f"order {rng.randint(10**9, 10**10 - 1)} k"][i % 7]
        texts.append(made)
        want.append(["phone:2:19", "phone:5:19", f"email:4:{made.find('. And')}", f"email:5:{len(made)}", "", "", ""][i % 7])
    got = {r["doc_id"]: r["spans"] for r in personal.report(_docs(spark, texts)).collect()}
    assert [got[i] for i in range(600)] == want


def test_kinds_that_the_base_misses_need_no_confirmed_span(spark):
    rows = personal.report(_docs(spark, [f"Reach us: (212) 555-01{i:02}" for i in range(40)] + ["joe [at] example.org"])).collect()
    assert all(r["spans"] == ("email:0:20" if r["doc_id"] == 40 else "phone:10:24") and r["n_phone"] == 0 for r in rows)


def test_every_labelled_proposal_is_counted(spark):
    """More labelled proposals than any sample held: all of them have a weight in the rows that the trees are fitted to."""
    docs = spark.range(45_000).select(F.col("id").alias("doc_id"), F.format_string("on 2024-0%d-1%d", F.col("id") % 9 + 1, F.col("id") % 7).alias("text"))
    wide = personal.marked(personal.proposals(docs)).filter("gen = 'wide_number'")
    known = personal.labelled(wide).filter("label is not null").withColumn("_h", F.xxhash64("doc_id", "start", "match"))
    seen = personal.counted(known).agg(F.sum("weight"), F.count("*")).first()
    assert seen[0] == 45_000 and seen[1] < 100
