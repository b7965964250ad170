"""One query per corpus operator over its whole table, with its SQL check where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe, decontam, exact_dedup, fim, language, line_dedup, main_text, minhash, personal, prefix_trie, quality, token_files, url_filter
from attestra.session import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


ORACLES["op1_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] FOR i IN range(1, len(words) - 2)] END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""


@register
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text.extracted("html").alias("text"))
    return pages.select("*", F.length("text").cast("long").alias("n_chars"))


@register
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.encoded(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder)
    return token_files.token_checksums(spark, folder)


@register
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.production_list(spark))


ORACLES["op5_url_filter"] = """
WITH u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN path LIKE '/%' AND regexp_matches('.' || host, '[.](ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]example[.](com|net|org)$') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@register
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("_row.doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.col("_text").alias("text"))


ORACLES["op6_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM l
), k AS (SELECT *, array_to_string(words, ' ') AS key, row_number() OVER (ORDER BY doc_id, pos) AS place FROM w),
c AS (SELECT key, any_value(words) AS words, min(place) AS first FROM k WHERE len(words) > 0 GROUP BY key),
v AS (
  SELECT key, first, i, array_to_string(words[1 : i - 1] || words[i + 1 : len(words)], ' ') AS variant
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM c WHERE len(words) >= 8)
), g AS (SELECT variant, i, min(first) AS lo FROM v GROUP BY ALL),
late AS (
  SELECT key FROM v JOIN g USING (variant, i) WHERE lo < first
  UNION SELECT v.key FROM v JOIN c ON c.key = v.variant WHERE len(c.words) >= 8 AND c.first < v.first
  UNION SELECT c.key FROM v JOIN c ON c.key = v.variant WHERE len(c.words) >= 8 AND v.first < c.first
), d AS (
  SELECT k.*, len(k.words) > 0 AND (late.key IS NOT NULL OR place > c.first) AS gone FROM k LEFT JOIN c USING (key) LEFT JOIN late ON late.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM d GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


@register
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op7_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@register
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(table(spark, sf_dir, "documents"))
    return language.identify(table(spark, sf_dir, "pages"), model)


@register
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(table(spark, sf_dir, "documents"))


@register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


ORACLES["op10_quality_rules"] = r"""
WITH w AS (
  SELECT doc_id, source, text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), t AS (
  SELECT *, len(words) AS n, [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)] AS windows
  FROM w
), o AS (SELECT doc_id, unnest(windows) AS win, generate_subscripts(windows, 1) AS i FROM t),
r AS (SELECT doc_id, win FROM o GROUP BY ALL HAVING count(*) > 1),
h AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT o.doc_id, unnest([o.i, o.i + 1, o.i + 2]) AS p FROM o JOIN r USING (doc_id, win)) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS again
  FROM (SELECT doc_id, unnest(lines) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT doc_id, source, n AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(again, 0) AS n_dup_lines, coalesce(k, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM t LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)
), f AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > 3 * n_words AS f3, 2 * n_dup_lines > n_lines AS f4 FROM m
), hosts AS (
  SELECT source, count(*) AS n, unnest(['1', '2', '3', '4']) AS rule, unnest([sum(f1::INT), sum(f2::INT), sum(f3::INT), sum(f4::INT)]) AS k
  FROM f WHERE source IS NOT NULL GROUP BY source
), p AS (
  SELECT rule, sum(k) / sum(n) AS mean, count(*) AS h, sum(n) AS total, sum(k * k / n) / sum(n) AS sq FROM hosts GROUP BY rule
), q AS (
  SELECT rule, mean, mean * (1 - mean) AS spread, sq - mean * mean - mean * (1 - mean) * h / total AS between_hosts FROM p
), s AS (
  SELECT rule, mean, CASE WHEN spread = 0 OR between_hosts <= 0 THEN 1e6 ELSE least(greatest(spread / between_hosts - 1, 1.0), 1e6) END AS strength FROM q
), bad AS (
  SELECT DISTINCT source FROM hosts JOIN s USING (rule) WHERE (k + mean * strength) / (n + strength) > 0.5
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (f1 OR f2) AS base_failed, (NOT (f1 OR f2) AND bad.source IS NULL) AS kept
FROM f LEFT JOIN bad USING (source)
"""


@register
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("_output", 256).alias("output_sha256"), F.sha2(fim.restored("_output", "_form"), 256).alias("restored_sha256")]
    return docs.select("_row.doc_id", F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix_chars").alias("prefix_chars"), F.col("_middle_chars").alias("middle_chars"), *digests)


ORACLES["op11_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (
  SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM h
), p AS (SELECT *, left(t, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""


@register
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op12_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = """
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) t(i)
), o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), t AS (SELECT conv_id, pos, length(text) AS chars, sha256(length(role)::VARCHAR || ':' || role || ':' || text) AS id FROM o),
c AS (SELECT conv_id, list(struct_pack(id := id, chars := chars) ORDER BY pos) AS turns FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT), lambda r, b: xor(r >> 8, tab[xor(r, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h
  FROM c, crc
), r AS (SELECT a.conv_id, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS turns FROM h a LEFT JOIN c b ON b.conv_id = a.base),
p AS (
  SELECT conv_id, d, len(turns) = d AS ended, sha256(array_to_string(list_transform(turns[1:d], lambda x: x.id), '/')) AS node,
         CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(turns[1:d - 1], lambda x: x.id), '/')) END AS parent, CASE WHEN d > 0 THEN turns[d].chars ELSE 0 END AS chars
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)
), n AS (
  SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends
  FROM p GROUP BY d, node
), k AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, node)),
s AS (
  SELECT a.d, a.node, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens
  FROM v b JOIN p a ON a.conv_id = b.conv_id AND a.d <= b.d GROUP BY ALL
)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s USING (d, node) LEFT JOIN n u ON u.d = v.d - 1 AND u.node = v.parent
"""
