"""Delimited files read in splits against the reading of the same text as one row."""

import os
import random

import pytest

from attestra.sources import delimited


@pytest.fixture
def split_bytes(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


def random_file(rng):
    sep = rng.choice([",", ";", "\t", "|"])
    cell = lambda: rng.choice(["a", "", " ", "x y", "é1", '"q"', f'"s{sep}t"', '"two\nlines"', '"crlf\r\nin"', '""', '"a ""b"" c"', '"\n"', '5"6"7', '"\n\n\n"'])
    rows = [sep.join(["key", "name", ""])] + [sep.join(cell() for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(rng.randint(0, 25))]
    rows = [r for r in rows for r in ([r, ""] if rng.random() < 0.1 else [r])]
    text = rng.choice(["\n", "\r\n"]).join(rows) + rng.choice(["", "\n"])
    if rng.random() < 0.4:  # a quote that nothing closes
        at = rng.randint(0, len(text))
        at = at if text[at : at + 1] != "\n" or text[at - 1 : at] != "\r" else at - 1
        text = text[:at] + '"' + text[at:]
    return text


@pytest.mark.parametrize("size", [40, 10_000])
def test_files_in_splits_equal_whole_texts(spark, tmp_path, split_bytes, size):
    rng = random.Random(size)
    texts = {f"f{k}.csv": random_file(rng) for k in range(24)} | {"blank.csv": " \n\n", "empty.csv": "", "odd.csv": 'a,b\n1,"2\n3,4\n', "last.csv": 'a,b\n"1\n2",3"', "one.csv": '"'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "skip.txt").write_text("not this")
    whole = delimited.read_delimited(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))
    tidy = lambda rows: sorted((os.path.basename(r.doc_id), r.r, r.is_header, r.header, r.cells, r.fitted) for r in rows)
    want = tidy(whole.collect())
    split_bytes(size)
    lines = delimited.read_split_lines(spark, str(tmp_path), "*.csv")
    assert (lines.filter("start > 0").count() > 50) == (size < 100)
    got = tidy(delimited.read_delimited_files(spark, str(tmp_path), "*.csv").collect())
    assert got == want and len(want) > 150
