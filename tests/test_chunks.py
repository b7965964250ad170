import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra.operators import chunks as C
from attestra.operators import packing
from attestra.scale import rank_within
from attestra.sources import blocks as B
from tests import spec

item = st.tuples(st.integers(0, 12), st.booleans(), st.booleans())


@settings(max_examples=300, deadline=None)
@given(st.lists(item, min_size=1, max_size=60), st.integers(1, 25), st.integers(1, 9))
def test_tiles_compose_to_the_plain_loop(items, limit, tile):
    sizes = [n for n, _, _ in items]
    opens = [o and i % 3 == 0 for i, (_, o, _) in enumerate(items)]
    closes = [c and i % 4 == 0 for i, (_, _, c) in enumerate(items)]
    starts = spec.pack(sizes, limit, opens, closes)
    size, start = -1, -1
    for at in range(0, len(items), tile):
        cut = slice(at, at + tile)
        ways = packing.tile_exits(
            np.arange(len(items))[cut], np.array(sizes[cut]), np.array(opens[cut], bool), np.array(closes[cut], bool), limit
        )
        size, start = packing.leave(ways, size, start)
        last = min(at + tile, len(items)) - 1
        assert size == -1 if closes[last] else start == starts[last]


def test_long_sequences_are_packed_like_short_ones(spark, monkeypatch):
    monkeypatch.setattr(packing, "TILE", 8)
    rng = random.Random(3)
    rows, want = [], {}
    for key in ("short", "long", "hot"):
        n = {"short": 5, "long": 40, "hot": 300}[key]
        sizes = [rng.randint(0, 30) for _ in range(n)]
        opens = [rng.random() < 0.05 for _ in range(n)]
        closes = [rng.random() < 0.05 for _ in range(n)]
        rows += [(key, i, s, n, o, c) for i, (s, o, c) in enumerate(zip(sizes, opens, closes))]
        want[key] = spec.pack(sizes, 60, opens, closes)
    df = spark.createDataFrame(rows, "k string, i int, s int, n int, o boolean, c boolean")
    got = packing.pack(df, "k", "i", "s", 60, "n", F.col("o"), F.col("c")).collect()
    assert len(got) == 345
    for r in got:
        assert r.start == want[r.k][r.i]


def test_chunks_respect_structure(spark):
    rows = [
        ("md", "md", 0, "L1", "heading", "A", "x" * 10, None, None), ("md", "md", 1, "L2-L3", "para", "A", "y" * 50, None, None),
        ("md", "md", 2, "L5", "para", "A", "z" * 50, None, None), ("md", "md", 3, "L7", "heading", "B", "w", None, None),
        ("x", "xlsx", 0, "S!A1:B9", "sheet", "S", "info", "S", None), ("x", "xlsx", 1, "S!A2:B2", "row", "S", "r2", "S", None),
        ("x", "xlsx", 2, "S!A3:B3", "row", "S", "r3", "S", None), ("x", "xlsx", 3, "T!A1:B1", "row", "T", "t", "T", None),
        ("p", "pptx", 0, "s1", "slide", "One", "a", None, 1), ("p", "pptx", 1, "s1.t1", "table_row", "One", "b", None, 1),
        ("f", "pdf", 0, "page1", "page", "Page 1", "p1", None, None), ("f", "pdf", 1, "page2", "page", "Page 2", "p2", None, None),
    ]
    df = spark.createDataFrame(
        rows, "doc_id string, doc_type string, seq int, anchor string, kind string, section string, text string, sheet string, slide int"
    )
    got = {(r.doc_id, r.anchor): (r.first_seq, r.last_seq, r.text) for r in C.make_chunks(df, 100).collect()}
    assert set(got) == {
        ("md", "L1-L3"), ("md", "L5"), ("md", "L7"), ("x", "S!A1:B9"), ("x", "S!A2:B3"), ("x", "T!A1:B1"), ("p", "s1"), ("f", "page1"), ("f", "page2"),
    }
    assert got["x", "S!A2:B3"] == (1, 2, "r2\nr3") and got["p", "s1"][2] == "a\nb"


def test_split_long(spark):
    rng = random.Random(1)
    texts = {i: "\n".join("x" * rng.randint(0, 40) for _ in range(rng.randint(1, 30))) for i in range(20)}
    texts[99] = "y" * 500 + "\nshort"
    df = spark.createDataFrame(list(texts.items()), "k int, t string")
    got = {}
    for r in C.split_long(df, "k", "t", 200).collect():
        got.setdefault(r.k, {})[r.part] = r.text
    for k, text in texts.items():
        if len(text) <= 200:
            assert got[k] == {1: text}
            continue
        lines = text.split("\n")
        starts = spec.pack([len(x) for x in lines], 100)
        parts = ["\n".join(x for x, s in zip(lines, starts) if s == at) for at in sorted(set(starts))]
        assert got[k] == {i + 1: p for i, p in enumerate(parts)}


def test_rank_within_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {(r.k, r.v): r.rn for r in rank_within(df, ["k"], ["v"]).collect()}
    assert len(got) == 1000
    for k in {k for k, _ in rows}:
        mine = sorted(v for kk, v in rows if kk == k)
        assert [got[k, v] for v in mine] == list(range(1, len(mine) + 1))


def test_doc_ids(spark):
    paths = [f"h{i % 3}/index.html" if i % 2 else f"h{i}/index.md" for i in range(12)] + ["calc.xlsx", "a/b/x.txt", "a/x.txt", "top.md", "Top.md", "index-2.md"]
    paths = sorted(set(paths))
    existing = ["index", "index-3", "top-5", "index-h2"]
    want = spec.doc_ids(paths, existing, lambda t: "".join(c if c.isalnum() else "-" for c in t.lower()))
    new = spark.createDataFrame([(p,) for p in paths], "path string")
    held = spark.createDataFrame([(e,) for e in existing], "doc_id string")
    got = {r.path: r.doc_id for r in C.assign_doc_ids(new, held).collect()}
    assert len(set(got.values()) | set(existing)) == len(paths) + len(existing)
    assert got == want


def test_line_chunks_equal_packed_blocks(spark):
    rng = random.Random(9)
    rows = []
    for i in range(30):
        n = rng.choice([1, 3, 12, 80])
        rows.append((i, "\n".join(" " * (rng.random() < 0.2) + "w" * rng.choice([0, 1, 7, 30, 120]) for _ in range(n)), f"s{i % 3}"))
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    want = {(r.doc_id, r.first_seq, r.last_seq, r.anchor, r.text) for r in C.make_chunks(B.line_blocks(docs), 100).collect()}
    for tile in (1, 20, 1000):
        got = C.line_chunks(docs, chunk_chars=100, carry=["source"], tile=tile).collect()
        assert {(r.doc_id, r.first_seq, r.last_seq, r.anchor, r.text) for r in got} == want
        assert all(r.source == f"s{r.doc_id % 3}" for r in got)
