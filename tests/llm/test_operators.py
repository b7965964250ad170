"""Every operator against its contract in plain Python, over texts with nulls, repeats, ties and odd shapes."""

import hashlib
import random

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from attestra.llm import bpe, decontam, language, line_dedup, main_text, minhash, quality, token_files, url_filter
from tests.llm import plain

SCHEMA = "doc_id long, text string, source string, n_words int, _id string, rep string"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["The", "of", "é", "Straße", "data", "x1", "end.", "a", "B,", "line", "ÉTÉ", "go", "日本", "13", "<|x", "ſt"]
    base = [" ".join(rng.choice(vocab) + (str(rng.randint(0, 30)) if rng.random() < 0.5 else "") for _ in range(rng.randint(1, 130))) for _ in range(n // 3)]
    texts = [None, "", " \t\n", "one", "one", "One two three", "é" * 5000 + " x", "a b c d"]
    for b in base:
        w = b.split(" ")
        near = list(w)
        for _ in range(max(1, len(w) // 40)):
            near[rng.randrange(len(near))] = "edit" + str(rng.randint(0, 9))
        cut = list(w)
        del cut[rng.randrange(len(cut))]
        texts += [b, " ".join(near), "\n".join([" ".join(cut), b, "Shared footer line."]), b.upper()]
    return [(i, t, f"host{i % 4}" if i % 7 else None, i, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA).repartition(3)


def test_near_duplicates(frame, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(frame, 4).collect()}
    assert got == plain.near_duplicates([(d[0], d[1]) for d in docs])


def test_near_duplicates_of_a_family_that_no_star_joins(spark):
    """Texts of a chain: neighbours are similar, the ends are not, and the smallest id is at one end."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 200])) for k in range(40)] + [(100 + k, " ".join(words[:60] + [f"u{k}_{i}" for i in range(100)])) for k in range(40)]
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == plain.near_duplicates(rows)


def test_near_duplicates_without_rows_or_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (0, "A b c d e")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, minhash.near_duplicates(rows, 4).collect()))) == ["(0, 2, 0, True)", "(1, 2, 0, False)", "(1, 2, 0, False)", "(None, 2, None, True)"]


def test_decontamination(spark, frame, docs):
    long = max((d[1] for d in docs if d[1]), key=len).split(" ")
    items = [(1, docs[20][1]), (2, " ".join(docs[24][1].split(" ")[:15])), (3, "one"), (4, None), (5, ""), (6, "never seen words"), (None, docs[28][1]), (2, docs[32][1]), (7, " ".join(long[3:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.contamination(frame, bench).collect())
    assert got == sorted(plain.contamination([(d[0], d[1]) for d in docs], items))
    kept = {r["doc_id"] for r in decontam.decontaminated(frame, bench).collect()}
    assert kept == {r[0] for r in got if not r[5]} and kept != {r[0] for r in got}
    assert decontam.contamination(frame, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.contamination(frame.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a b q c d y"), (2, "a b c d"), (3, "a x x x x b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    found, _ = decontam.matches(docs, bench, slop=1)
    assert sorted(r["_id"] for r in found.collect()) == [1, 2]


def test_line_dedup(frame, docs):
    got = {r["_row"]["doc_id"]: r for r in line_dedup.deduplicated(frame).collect()}
    want = plain.line_dedup([(d[0], d[1]) for d in docs])
    assert [got[d[0]]["_text"] for d in docs] == want
    assert sum(r["_dropped"] for r in got.values()) > 20 and got[5]["_row"]["_id"] == "x"
    assert line_dedup.deduplicated(frame.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, 10**6])
def test_line_dedup_of_random_edits(spark, monkeypatch, sent):
    """Also where the sides are joined by shuffling instead of being sent."""
    monkeypatch.setattr(line_dedup, "SENT_ROWS", sent)
    rng = random.Random(9)
    lines = []
    for _ in range(25):
        w = [rng.choice("abc") for _ in range(rng.randint(6, 12))]
        for _ in range(6):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(v))
                v[at : at + rng.randint(0, 1)] = [rng.choice("abcd")] * rng.randint(0, 1)
            lines.append("  ".join(v))
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(len(lines) // 3)]
    got = {r["_row"]["doc_id"]: r["_text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == plain.line_dedup(rows)


def test_line_dedup_sends_no_long_arrays(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SENT_ROWS", 50)
    sizes = []
    monkeypatch.setattr(line_dedup, "sent", lambda df, rows: sizes.append((df.columns, rows)) or df)
    docs = spark.createDataFrame([(1, "a"), (2, "\n".join(["a"] * 100))], "doc_id long, text string")
    assert [r["_dropped"] for r in line_dedup.deduplicated(docs).orderBy("_row.doc_id").collect()] == [0, 100]
    assert sizes[-1] == (["_id", "_t", "drops"], 101)


def test_quality(frame, docs):
    got = {r["doc_id"]: r for r in quality.quality_report(frame.withColumnRenamed("n_words", "_m")).collect()}
    for d in docs:
        r, want = got[d[0]], plain.quality(d[1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, d
        assert not (r["base_failed"] and r["kept"])
    whole = {r["_row"]["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_rules(frame).collect()}
    assert whole == {i: (r["base_failed"], r["kept"]) for i, r in got.items()}
    assert quality.quality_report(frame.limit(0)).count() == 0


def test_bad_hosts_lose_their_good_documents(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good if i % 50 else good + " x", f"h{i % 5}") for i in range(400)] + [(1000 + i, "short" if i % 9 else good, "junk") for i in range(90)]
    got = quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["kept"] for r in got if r["doc_id"] < 1000} == {True} and {r["kept"] for r in got if r["doc_id"] >= 1000} == {False}


def test_bpe_equals_the_library(frame, docs):
    library = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    extra = ["a<|endoftext|>b <|startoftext|>", "İΣΑΣ ΟΔΟΣ x\x1fy\x85z", "é ́x it's I'VE 12ab3 …", "x" * 5000, "ab" * 3000 + "<|endoftext|", "١٢ ½ ⅷ", "\u00a0a\u2003b"]
    tables = frame.select("doc_id", "text").union(frame.sparkSession.createDataFrame(list(enumerate(extra, 5000)), "doc_id long, text string"))
    texts = {d[0]: d[1] or "" for d in docs} | dict(enumerate(extra, 5000))
    for r in bpe.encoded(tables).collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want.ids
        assert r["decoded"] == library.decode(want.ids, skip_special_tokens=False) and r["n_tokens"] == len(want.ids)


def test_token_files(spark, frame, docs, tmp_path):
    library = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    folder = f"file://{tmp_path}/tokens"
    odd = spark.createDataFrame([(None, "x"), (7, "again"), (10**12, "<|endoftext|> é")], "doc_id long, text string")
    token_files.write_tokens(frame.select("doc_id", "text").union(odd), folder, shard_tokens=500)
    got = sorted((tuple(r) for r in token_files.read_tokens(spark, folder).collect()), key=lambda r: r[1])
    texts = [(d[0], d[1]) for d in docs] + [(None, "x"), (7, "again"), (10**12, "<|endoftext|> é")]
    texts.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r[0] for r in got] == [t[0] for t in texts]
    at = 0
    for (_, start, n, ids), (_, t) in zip(got, texts):
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert start == at and n == len(want) and np.frombuffer(ids, "<u4").tolist() == want
        at += n
    token_files.write_tokens(frame.limit(0), folder + "2")
    assert token_files.token_checksums(spark, folder + "2").count() == 0


def test_wavelet_matrix():
    ids = (np.random.default_rng(2).zipf(1.3, 30000) % 49408).astype("<u4")
    m = token_files.Shard(token_files.shard([5], [len(ids)], ids)).matrix
    assert (m.all() == ids).all() and [m.access(i) for i in range(0, 30000, 997)] == ids[::997].tolist()
    for token in (1, 2, 9, 60, 49407, 2**20):
        at = np.flatnonzero(ids == token)
        assert m.count(token) == len(at) and m.count(token, 50, 999) == ((at >= 50) & (at < 999)).sum()
        assert [m.occurrence(token, k) for k in range(min(len(at), 20))] == at[:20].tolist() and m.occurrence(token, len(at)) is None


PAGES = [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>Fish &amp; chips,&nbsp;caf&eacute;<p>Two", "Fish & chips, café\nTwo"),
    ("<nav><p>Menu, of, things, and, more, of, it, all, day, long</p></nav><article><h1>Head</h1><p>Text, one.</p></article><footer><p>foot</p></footer>", "Head\nText, one."),
    ("<body><div id='sidebar'><p>side, side, side, side</p></div><div class='post'><p>" + "Long, text. " * 20 + "</p><p>More.</p><div class='comments'><p>" + "c, " * 99 + "</p></div></div>", " ".join(["Long, text."] * 20) + "\nMore."),
    ("<article><p>a<script>if (1 < 2) { '<p>x' }</script>b<!-- <p>no --></p><form><input><p>Mail, us, now</p></form><aside>Ad</aside>c</article>", "ab\nc"),
    ("<div>" * 3000 + "<p>Deep, very deep, text that is long enough</p>", "Deep, very deep, text that is long enough"), ("<article><p title='a>b'>x</p><p>y <b>z", "x\ny z"),
]


def test_main_text(spark):
    rows = spark.createDataFrame([(i, h, "u") for i, (h, _) in enumerate(PAGES * 2)], "page_id long, html string, text string")
    got = {r["page_id"]: r["t"] for r in rows.select("page_id", main_text.extracted("html").alias("t")).collect()}
    assert [got[i] for i in range(len(PAGES) * 2)] == [want for _, want in PAGES * 2]


@pytest.mark.parametrize("size", [100, 10_000, 1_000_000])
def test_main_text_of_pages_with_long_attribute_values(size):
    """Values are read to their closing quote; quotes that never close, or stand where no value begins, end with the tag."""
    value = '{"class": "ad", "id": "x", hidden role=menu <b>leaks, a lot</b>} ' * (size // 60)
    assert main_text.main_text(f"<article><p data-x='{value}'>One, two.</p><p>Three.</p></article>") == "One, two.\nThree."
    assert main_text.main_text(f'<article><p data-x="{value.replace(chr(34), chr(39))}">One, two.</p></article>') == "One, two."
    words = "word " * (size // 5)
    assert main_text.main_text(f"<article><p title=\"open>One, two.</p><p>{words}</p></article>") == f"One, two.\n{words.strip()}"
    assert main_text.main_text(f"<article><p it's>One, it's two.</p><p>{words}</p></article>") == f"One, it's two.\n{words.strip()}"


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "content with-comments", "entry social-share-enabled", "elementor-widget-container", "widget", "banner"])
def test_main_text_in_wrappers_named_like_boxes(name):
    text = "A long sentence, with commas, that goes on and on for the reader. " * 3
    want = "\n".join([text.strip()] * 3)
    box = f"<div class='comments'><p>{text * 2}</p></div><div class='ad-slot'><p>Buy, buy, buy</p></div>"
    side = "<div class='sidebar'><p>About, us, and, more</p></div>"
    whole = "".join(f"<p>{text}</p>" for _ in range(3))
    assert main_text.main_text(f"<body>{side}<div class='{name}'><div class='post'>{whole}{box}</div></div><p>Copyright</p></body>") == want
    parts = "".join(f"<div class='{name}'><p>{text}</p></div>" for _ in range(3))
    assert main_text.main_text(f"<body><article>{parts}</article></body>") == want


def test_main_text_without_comments_that_are_longer():
    text = "A long sentence, with commas, that goes on and on for the reader. " * 3
    for name in ("comments", "comment-list"):
        assert main_text.main_text(f"<body><div><p>{text}</p><p>{text}</p></div><div class='{name}'>" + f"<p>{text}</p>" * 3 + "</div></body>") == f"{text.strip()}\n{text.strip()}"
    assert main_text.main_text("<div class='notice'><p>Closed, today</p></div>") == "Closed, today"
    assert main_text.main_text("<div class='widget'>" * 20000 + f"<p>{text}</p>") == text.strip()


def test_url_filter(spark):
    rng = random.Random(4)
    hosts = ["a.net", "Example.NET", "x.example.net", "example.com", "q.example.com", "notexample.com", "e.org", "spam-farm.example.com", "net", ""]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/de/x', '/en/', '/en', '/fr/1?x=/de/', '#/fr/', '?/en/'])}" for _ in range(200)] + [None, "", "no scheme", "://", "a://b://c/de/"]
    rules = dict(url_filter.RULES)

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = rest[:cut].translate(plain.UP), rest[cut:].split("?")[0].split("#")[0]
        fits = lambda e: ("." + host).endswith("." + e.split("/", 1)[0]) and path.startswith("/" + e.split("/", 1)[1])
        rule = max((e for e in rules if fits(e)), key=len, default=None)
        return host, path, rule, rules[rule] if rule else "block" if any(map(fits, url_filter.BLOCKED)) else "allow"

    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h"), (None, None, None)], "page_id long, url string, host string")
    got = url_filter.judged(pages, url_filter.production_list(spark)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *judge(u))) for i, u in [*enumerate(urls), (0, urls[0]), (None, None)])
    assert url_filter.judged(pages.limit(0), url_filter.production_list(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.judged(pages, url_filter.production_list(spark).limit(0)).collect()} == {"allow"}


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h"), "id", F.lit(".com/")).alias("entry"))
    blocks = 2000 * url_filter.BITS_PER_KEY // 256
    blooms = url_filter.bloom(listed, blocks)
    probe = spark.range(12000).select("id", F.concat(F.lit("h"), "id", F.lit(".com/")).alias("key"))
    block, words = url_filter._place(F.col("key"), blocks)
    hit = probe.withColumn("block", block).join(blooms, "block").filter(" and ".join("true" for _ in "x"))
    for i, w in enumerate(words):
        hit = hit.filter(F.col(f"w{i}").bitwiseAND(w) == w)
    ids = {r["id"] for r in hit.select("id").collect()}
    assert set(range(2000)) <= ids and len(ids) < 2000 + 300


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 100")
    model = language.train(docs.filter("doc_id % 2 = 0"), sample=100)
    held = docs.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("<p>"), F.regexp_replace("text", "<", " ")).alias("html"), "lang")
    got = language.identify(held.drop("lang"), model).join(held.select("page_id", F.col("lang").alias("true")), "page_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("true")).cast("int")), F.count("*")).first()
    assert n > 300 and right > 0.97
    odd = spark.createDataFrame([(1, None, None), (2, "http://a.fr/fr/", ""), (2, "http://a.fr/fr/", ""), (None, "x", "<html lang=de>")], "page_id long, url string, html string")
    assert language.identify(odd, model).count() == 4 and language.identify(odd.limit(0), model).count() == 0


def test_language_model_counts_whole_documents_and_small_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "GRAMS", 60)
    rng = random.Random(6)
    many = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(50)), "en") for i in range(100)]
    docs = spark.createDataFrame(many + [(1000, "ñ " * 15_000 + "öö " * 15_000, "xx")], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.index) == 60 and {"ñ", "ö", "öö"} <= set(model.index)
    assert model.likelihoods("ñ ñ öö")[model.languages.index("xx")] == 0.0


def test_language_sample_of_rows_that_share_an_id(spark):
    rows = [(i if i else None, f"text {i} {k}", f"l{i}") for i in range(10) for k in range(200)] + [(77, "same", "same")] * 200
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=10)
    assert model.languages == sorted([f"l{i}" for i in range(10)] + ["same"])


def test_markup_and_host_decide_where_the_text_does_not():
    model = language.TextModel(["de", "en"], {"a": [5.0, 5.0]})
    assert model.likelihoods(None) == [0.0, 0.0] and model.likelihoods("a a") == [0.0, 0.0]


def test_digest_helpers():
    assert plain.sha("") == hashlib.sha256(b"").hexdigest()
