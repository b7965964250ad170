"""Fill-in-the-middle, exact duplicates and the prefix trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import exact_dedup, fim, prefix_trie, queries
from tests.llm.plain import sha

MARKS = ("<P>", "<S>", "<M>")


def plain_fim(i, text):
    t = text or ""
    x = sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    if not t or any(m in t for m in MARKS) or h3 % 100 >= 90:
        return i, n, "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if form == "spm" else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return i, n, form, a, b - a, sha(out), sha(t)


@pytest.mark.parametrize("alphabet", ["a", "é", "aé", "日", "a" * 30 + "é", "a" * 400 + "😀", "😀a"])
def test_boundaries_of_every_form(alphabet):
    rng = random.Random(len(alphabet))
    for size in (0, 1, 7, 70_000, 150_000):
        text = "".join(rng.choice(alphabet) for _ in range(size))
        cuts = fim.Boundaries(text.encode())
        assert len(cuts) == len(text) + 1
        for k in {0, len(text), *(rng.randint(0, len(text)) for _ in range(40))}:
            assert cuts.select(k) == len(text[:k].encode())


def test_containers_take_the_smallest_form():
    def kinds(text):
        return {type(c).__name__ for c in fim.Boundaries(text.encode()).containers}

    assert kinds("a" * 70_000) == {"Runs"}
    assert kinds("é" * 34_000) == {"Bitmap", "Array"}  # the last container is short
    assert "Array" in kinds("😀" * 500)
    mask = np.zeros(fim.SPAN, bool)
    mask[::17] = True
    assert isinstance(fim.container(mask), fim.Array)
    mask[::2] = True
    assert isinstance(fim.container(mask), fim.Bitmap)


def test_fill_in_middle(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "a", "é", "<P", "<<S", "x<P>y", "<M>", "é<", " \n\t", "日本" * 40_000, "😀" * 3, "same", "same"]
    texts += ["".join(rng.choice("ab<>PSMé日😀 \n") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [(i, t, "n", i) for i, t in enumerate(texts)] + [(None, "no id", "n", 0), (-4, "less", "n", 0), (3, "é", "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _form string, n int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, map(tuple, queries.op11_fill_in_middle(spark, str(tmp_path)).collect())))
    assert got == sorted(str(plain_fim(i, t)) for i, t, _, _ in rows)
    assert {re.search("plain|psm|spm", g)[0] for g in got} == {"plain", "psm", "spm"}
    whole = fim.fill_in_middle(docs)
    assert whole.select("_row.*").columns == docs.columns
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    other = fim.fill_in_middle(docs, seed=2).filter("_form <> 'plain'").select("_output").collect()
    assert set(other) != set(whole.filter("_form <> 'plain'").select("_output").collect())


def plain_exact(docs):
    """docs: (id, text). Rows as the query gives them; a missing id comes after all others."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, sha(t)) for k, i in enumerate(ids)]
    return sorted(map(str, out))


def copies(seed=5):
    rng = random.Random(seed)
    texts = [None, None, "", " ", "\n\t ", "a", "a ", " a", "a b", "a b", "a\t\r\nb", "a  b", "é" * 33, "é" * 33]
    for _ in range(12):
        t = "".join(rng.choice("ab \n😀") for _ in range(rng.randint(1, 90)))
        texts += [t, t.replace(" ", "  "), t[:-1] + "x", t[: len(t) // 2], "x" + t, t]
    rows = [(rng.randint(-500, 500) * 1000 + i, t) for i, t in enumerate(texts)]
    return rows + [(None, "a b"), (None, "nothing else"), (None, "nothing else"), rows[5], rows[-1]]


@pytest.mark.parametrize("size,digest", [(4096, F.xxhash64), (4, F.xxhash64), (4, lambda c: F.length(c).cast("long")), (7, lambda c: F.lit(1).cast("long"))])
def test_exact_duplicates(spark, size, digest):
    """Also where blocks of different contents share a hash: the names tell them apart."""
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in copies()], "doc_id long, text string, name int, level int").repartition(3)
    got = sorted(str(tuple(r)) for r in exact_dedup.exact_duplicates(docs, size=size, digest=digest).collect())
    assert got == plain_exact(copies())


def test_exact_duplicates_of_long_texts_and_one_large_group(spark):
    base = "".join(random.Random(1).choice("abcdefgh ") for _ in range(300_000))
    texts = [base, base, base[:-1] + "z", "z" + base[1:], base[:4096], base[:4096], base[4096:8192]] + ["hot copy"] * 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_duplicates(docs).collect()) == plain_exact(enumerate(texts))
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_rows_that_stay(spark):
    rows = copies()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _kept string").repartition(3)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = {}
    for i, t in rows:
        want[norm(t)] = min((x for x in (want.get(norm(t), (True, 0)), (i is None, i or 0))))
    assert sorted((norm(r.text), (r.doc_id is None, r.doc_id or 0)) for r in left.collect()) == sorted(want.items())


def test_names_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(copies(), "doc_id long, text string")
    one, two = (sorted(str((r.doc_id, r.level, r.name)) for r in exact_dedup.named(docs.repartition(n), size=4).collect()) for n in (1, 5))
    assert one == two


def test_no_python_in_exact_dedup(spark):
    docs = spark.createDataFrame(copies(), "doc_id long, text string")
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_trie(rows):
    def key(r):
        role, text = r[2] or "", r[3] or ""
        return r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()

    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in children[p])
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(made[c]) == len(p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], sha(ends)))
    return sorted(map(str, out))


def talks(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-20, conversations), 100, 101, 102, 250, 300, 345, 10**12, 10**12 + 7]:
        for k in range(rng.choice([1, 2, 3, 5, 7, 12, 30])):
            rows.append((c, rng.choice([k, k, k, 1, None]), rng.choice(["user", "user", "bot", None]), rng.choice(["a", "a", "b", "é😀", None, "long text"])))
    rows += [(None, 1, "user", "nobody"), (7, 1, "ab", "c"), (8, 1, "a", "bc"), rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("first,later", [(8, 32), (2, 3), (1, 1)])
def test_trie(spark, first, later):
    rows = talks(first) if later > 1 else [r for r in talks(first, 8) if (r[1] or 0) < 4]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, key int, pos int").repartition(3)
    assert sorted(str(tuple(r)) for r in prefix_trie.trie(frame, first, later).collect()) == plain_trie(rows)


def test_trie_of_long_equal_and_empty_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, k, "user", "x") for c in range(20) for k in range(45)] + [(40, k, "user", f"turn {k % 7}") for k in range(200)] + [(701, 0, "user", "alone")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(str(tuple(r)) for r in prefix_trie.trie(frame).collect())
    assert got == plain_trie(rows)
    assert prefix_trie.trie(frame.limit(0)).count() == 0
