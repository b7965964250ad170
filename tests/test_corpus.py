"""The ingest job: what changes, what fails, and versions that are whole or not there."""

import hashlib

import pytest

from attestra.operators.corpus import Corpus

MD = "---\ntitle: Plan\nowner: x\nauthor: me\n---\n# Head\n\nSome words.\n\n| Part | Price |\n|---|---|\n| bolt | 4.5 |\n| nut | n/a |\n"
FILES = {
    "a/plan.md": MD, "b/plan.md": "# Other plan\n\ntext", "list.csv": "id;day\n1;2024-05-06\n2;\n", "page.html": "<html><head><title>Page &amp; co</title></head><body><p>one</p><p>two</p></body></html>",
    "note.txt": "first\n\nsecond", "calc.txt": "x", "photo.png": "no reader", "broken.md": None,
}


def files(spark, texts, mtime=1.0):
    rows = [(p, len(t or ""), mtime, hashlib.sha256((t or "").encode()).hexdigest(), t) for p, t in texts.items()]
    return spark.createDataFrame(rows, "path string, size long, mtime double, sha256 string, text string")


def told(report):
    return {r.status: r.listed for r in report.collect()}


def state(corpus, version=None):
    return {name: sorted(map(str, corpus.read(name, version).collect())) for name in ("docs", "blocks", "chunks", "columns", "cells")}


def test_versions(spark, tmp_path, monkeypatch):
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    assert corpus.version() == 0 and corpus.read("blocks").count() == 0
    assert told(corpus.ingest(files(spark, FILES))) == {"new": "a/plan.md, b/plan.md, calc.txt, list.csv, note.txt, page.html", "failed": "broken.md, photo.png"}
    docs = {r.path: r for r in corpus.read("docs").collect()}
    assert {p: (r.doc_id, r.title) for p, r in docs.items()} == {
        "a/plan.md": ("plan", "Plan"), "b/plan.md": ("plan-b", "Other plan"), "list.csv": ("list", "list"), "page.html": ("page", "Page & co"), "note.txt": ("note", "note"), "calc.txt": ("doc-calc", "calc"),
    }
    assert docs["a/plan.md"].meta == {"title": "Plan", "author": "me"}
    assert sorted((r.doc_id, r.anchor, r.text) for r in corpus.read("blocks").collect() if r.doc_id in ("note", "list")) == [
        ("list", "R1", "Columns: id, day"), ("list", "R2", "id: 1 | day: 2024-05-06"), ("list", "R3", "id: 2"), ("note", "L1", "first"), ("note", "L3", "second"),
    ]
    columns = sorted((r.table_name, r.c, r.name, r.type) for r in corpus.read("columns").collect())
    assert columns == [("list__rows", 1, "id", "BIGINT"), ("list__rows", 2, "day", "VARCHAR"), ("plan__table_at_line_10", 1, "part", "VARCHAR"), ("plan__table_at_line_10", 2, "price", "DOUBLE")]
    assert sorted((r.r, r.c, r.v) for r in corpus.read("cells").collect() if r.doc_id == "plan") == [(2, 1, "bolt"), (2, 2, "4.5"), (3, 1, "nut"), (3, 2, None)]
    one = state(corpus)

    # a failure between two writes leaves the version before; another try takes its place
    later = {**FILES, "b/plan.md": "# New plan\n\ntext", "broken.md": "# Mended"}
    del later["note.txt"]
    write = Corpus._write

    def stop(self, number, tables):
        write(self, number, dict(list(tables.items())[:3]))
        raise OSError("disk gone")

    monkeypatch.setattr(Corpus, "_write", stop)
    with pytest.raises(OSError):
        corpus.ingest(files(spark, later))
    assert corpus.version() == 1 and state(corpus) == one
    monkeypatch.setattr(Corpus, "_write", write)
    report = told(corpus.ingest(files(spark, later)))
    assert report == {"new": "broken.md", "modified": "b/plan.md", "deleted": "note.txt", "unchanged": "a/plan.md, calc.txt, list.csv, page.html", "failed": "photo.png"}
    two = state(corpus)
    assert state(corpus, 1) == one and two != one
    assert sorted(r.title for r in corpus.read("docs").collect() if r.doc_id in ("plan-b", "broken")) == ["Mended", "New plan"]
    assert not corpus.read("blocks").filter("doc_id = 'note'").count()

    # touched files keep their rows, unreadable ones their document, and a compacted version holds the same
    assert told(corpus.ingest(files(spark, {**later, "a/plan.md": MD, "broken.md": None}, mtime=5.0)))["failed"] == "broken.md, photo.png"
    three = state(corpus)
    assert {k: v for k, v in three.items() if k != "docs"} == {k: v for k, v in two.items() if k != "docs"}
    corpus.compact()
    four = state(corpus)
    assert {k: v for k, v in four.items() if k != "docs"} == {k: v for k, v in three.items() if k != "docs"} and len(four["docs"]) == len(three["docs"])
    assert corpus.version() == 4 and state(corpus, 1) == one
    with pytest.raises(ValueError):
        corpus.read("docs", 9)
