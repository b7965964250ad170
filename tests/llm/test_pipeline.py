import numpy as np
import tokenizers

import corpus_pipeline
from attestra.llm import bpe
from tests.llm import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_a_brute_force_version(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*COLUMNS).orderBy("doc_id").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*COLUMNS).schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [r for r in rows if not plain.quality(r[1])[5]]
    texts = plain.line_dedup([(r[0], r[1]) for r in left])
    left = [(r[0], t) for r, t in zip(left, texts)]
    near = plain.near_duplicates(left, corpus_pipeline.WIDTH)
    left = [r for r in left if near[r[0]][2]]
    bad = {r[0] for r in plain.contamination(left, items) if r[5]}
    left = [r for r in left if r[0] not in bad]
    assert sorted(got) == [i for i, _ in left]
    assert 0 < len(left) < len(rows)
    library = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    for i, t in left:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want and got[i]["decoded_sha256"] == plain.sha(library.decode(want, skip_special_tokens=False))


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "x " * 60, "en", "s", 120)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
