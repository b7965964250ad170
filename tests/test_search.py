import math
import random

import pytest
from pyspark.sql import functions as F

from attestra.functions.stem import porter
from attestra.operators import search as S
from attestra.operators import vectors as V
from attestra.plans.search_queries import FAMILIES
from tests import spec

CHUNKS = [
    (1, "a", "Frame tests", "fatigue", "The frames cracked after long use, code QX-204"),
    (2, "a", "Frame tests", "results", "Testing the frame: tested twice. QX 204 and 204 QX"),
    (3, "b", "Market", "seats", "Xưởng gỗ, online orders grow"),
    (4, "c", "Notes", "", "cracks and crack growth; frames"),
]
SCHEMA = "chunk_id long, doc_id string, title string, section string, text string"


def queries(spark, *qs):
    return spark.createDataFrame([(1, i, q) for i, q in enumerate(qs)], "search_id int, query_no int, query string")


def test_query_terms(spark):
    rows = S.parse_queries(queries(spark, 'What is the "frame fatigue" of QX-204\'s, (test)')).orderBy("term_no").collect()
    assert [r.tokens for r in rows] == [["frame", "fatigue"], ["qx", "204", "s"], ["test"]]


def test_stems_phrases_and_folding(spark):
    chunks = spark.createDataFrame(CHUNKS, SCHEMA)

    def hits(q):
        return {r.chunk_id: r for r in S.bm25(chunks, queries(spark, q)).collect()}

    assert set(hits("testing")) == {1, 2}
    assert set(hits("frame")) == {1, 2, 4}
    assert set(hits("xuong")) == {3}
    assert set(hits("QX-204")) == {1, 2}
    both = hits("cracked frame")
    assert {k for k, r in both.items() if r.n_hit == r.n_terms} == {1, 4}


def test_bm25_value(spark):
    chunks = spark.createDataFrame(CHUNKS, SCHEMA)
    got = {r.chunk_id: r.score for r in S.bm25(chunks, queries(spark, "online"), stemmed=False).collect()}
    lengths = [len(S_tokens(" ".join(c[2:]))) for c in CHUNKS]
    avg = sum(lengths) / 4
    idf = math.log((4 - 1 + 0.5) / 1.5)
    assert abs(got[3] - idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[2] / avg))) < 1e-9


def S_tokens(text):
    import re

    return re.findall(r"[^\W_]+", text.lower())


def test_search_end_to_end(spark):
    chunks = spark.createDataFrame(CHUNKS, SCHEMA)
    hits = S.search(chunks, queries(spark, "cracked frame", "fatigue"), k=3).orderBy("place").collect()
    assert hits[0].chunk_id == 1 and hits[0].matched == ["q000000", "q000001"]
    only_b = spark.createDataFrame([("b",)], "doc_id string")
    assert [r.doc_id for r in S.search(chunks, queries(spark, "seat orders"), 3, allowed=only_b).collect()] == ["b"]


def test_diversify_is_the_greedy_pick(spark):
    rng = random.Random(5)
    rows = []
    for s in range(40):
        for i in range(rng.randint(1, 25)):
            rows.append((s, i, rng.choice("abcd"), rng.random()))
    df = spark.createDataFrame(rows, "search_id int, chunk_id int, doc_id string, score double")
    got = {}
    for r in S.diversify(df, 6, ["search_id"]).orderBy("search_id", "place").collect():
        got.setdefault(r.search_id, []).append(r.chunk_id)
    for s in range(40):
        assert got[s] == spec.greedy([(i, d, x) for ss, i, d, x in rows if ss == s], 6)


def test_snippets_and_pins(spark):
    words = " ".join(["pad"] * 40 + ["the", "frame", "cracked"] + ["end"] * 40)
    df = spark.createDataFrame([(1, words)], "id int, text string")
    got = S.snippets(df, "text", F.array(F.lit("frame"), F.lit("cracked")), 5).first().snippet
    assert got == "… pad pad the «frame» «cracked» …"
    blocks = spark.createDataFrame([("d", i, f"L{i}", t) for i, t in enumerate(["head", "Frames crack", "frame", "cracking frames"])], "doc_id string, seq int, anchor string, text string")
    hit = spark.createDataFrame([(1, "c", "d", 0, 3)], "search_id int, chunk_id string, doc_id string, first_seq int, last_seq int")
    pins = S.pin_blocks(hit, blocks, queries(spark, "the cracks of a frame")).orderBy("seq").collect()
    assert [p.anchor for p in pins] == ["L1", "L3"] or [p.anchor for p in pins] == ["L1"]


def test_exact(spark):
    blocks = spark.createDataFrame([("d", 0, "L1", "a+B is\n fine"), ("d", 1, "L2", "aab"), ("d", 2, "L3", "x" * 100 + "A+b" + "y" * 100)], "doc_id string, seq int, anchor string, text string")
    total, lines = S.exact_search(blocks, "A+b")
    assert total.first().n_blocks == 2
    assert [r.context for r in lines.collect()] == ["…a+B is fine…", "…" + "x" * 70 + "A+b" + "y" * 70 + "…"]
    assert S.exact_search(blocks, "a+b", regex=True)[0].first().n_blocks == 1
    assert S.exact_search(blocks, "a+b", k=1)[1].count() == 1


def test_nearest(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    qs = [[1.0, 0.0, 0.0], [0.0, 2.0, 0.1]]

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))

    want = sorted(rows, key=lambda r: (-round(max(cos(r[1], q) for q in qs), 12), r[0]))[:10]
    assert [r.vec_id for r in V.nearest(df, qs, 10).collect()] == [w[0] for w in want]


@pytest.mark.parametrize("name", ["long", "string"])
def test_nearest_of_many_searches(spark, monkeypatch, name):
    """Blocks of searches, ties, phrasings, missing and foreign vectors, ids of text: as by a plain loop."""
    rng = random.Random(5)
    given = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(300)]
    held = [(str(i) if name == "string" else i, v) for i, v in given]
    odd = [(held[0][0], None), (held[0][0], [1.0])]
    df = spark.createDataFrame(held + odd, f"vec_id {name}, embedding array<float>").repartition(5)
    asked = [(s, [rng.uniform(-1, 1) for _ in range(4)]) for s in range(7) for _ in range(1 + s % 2)]
    qs = spark.createDataFrame(asked + [(3, None), (9, None)], "search_id int, embedding array<double>")
    monkeypatch.setattr(V, "QUERY_VALUES", 12)

    def cos(a, b):
        n = max(math.hypot(*a), V.EPS) * max(math.hypot(*b), V.EPS)
        return sum(x * y for x, y in zip(a, b)) / n

    want = set()
    for s in {s for s, _ in asked}:
        sims = [(-round(max(cos(q, v) for t, q in asked if t == s), 9) + 0.0, i) for i, v in held]
        want |= {(s, r + 1, i) for r, (_, i) in enumerate(sorted(sims)[:6])}
    got = V.nearest_each(df, qs, 6).collect()
    assert {(r.search_id, r["rank"], r.vec_id) for r in got} == want and len(got) == len(want)
    assert V.nearest_each(df, qs.filter("search_id = 9"), 6).count() == 0
    assert V.nearest_each(df.limit(0), qs, 6).count() == 0


def test_word_families_of_the_check():
    """The words listed for the SQL of the flagship have the stem of the word they are listed under."""
    for word, family in FAMILIES.items():
        assert {porter(w) for w in family} == {porter(word)}


def test_search_results_as_read(spark):
    """Word hits have marked snippets and the anchors that answer; a hit by meaning alone its opening; filters hold for both."""
    texts = {1: "Frames\nThe frame cracked twice", 2: "Market\nSeats grow", 3: "Notes\n" + "wood " * 80, 4: "Frame\nhidden"}
    chunks = spark.createDataFrame(
        [(i, f"d{i}", "L1-L2", t.split("\n")[0], "", 0, 1, t) for i, t in texts.items()],
        "chunk_id long, doc_id string, anchor string, title string, section string, first_seq long, last_seq long, text string",
    )
    blocks = spark.createDataFrame(
        [(f"d{i}", n, f"L{n + 1}", line) for i, t in texts.items() for n, line in enumerate(t.split("\n"))], "doc_id string, seq long, anchor string, text string"
    )
    docs = spark.createDataFrame([(f"d{i}", f"in/d{i}.md", "csv" if i == 4 else "md") for i in texts], "doc_id string, path string, doc_type string")
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (4, [1.0, 0.1])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "search_id int, embedding array<double>")
    found = S.search_results(chunks, blocks, docs, queries(spark, "frames cracking"), 4, ["md"], "in/*", vectors, asked)
    got = {r.chunk_id: r for r in found.collect()}
    assert set(got) == {1, 3}
    assert got[1].ref == "d1#L1-L2" and got[1].snippet == "«Frames» The «frame» «cracked» twice" and got[1].best == ["L2"]
    assert got[3].matched == ["~semantic"] and got[3].snippet.startswith("Notes wood") and got[3].snippet.endswith(" …") and got[3].best == []
    assert S.search_results(chunks.limit(0), blocks, docs, queries(spark, "frames")).count() == 0
    assert {r.chunk_id for r in S.search_results(chunks, blocks, docs, queries(spark, "frames")).collect()} == {1, 4}
