"""Files that change or go; listings may come late, in pieces or twice."""

import os
from datetime import datetime

from attestra.streaming import refresh as S


def run(spark, where):
    query = S.stream_refresh(spark, f"{where}/listings", f"{where}/events", f"{where}/state", f"{where}/src", f"{where}/table", "*.md")
    query.awaitTermination(240)
    assert query.exception() is None
    return sorted(r.text for r in S.current_docs(spark, f"{where}/table", f"{where}/events").collect())


def events(spark, where):
    rows = spark.read.schema(f"{S.EVENT}, batch int").parquet(f"{where}/events").collect()
    return sorted((os.path.basename(r.path), r.listing, r.status) for r in rows)


def test_files_that_change_or_go(spark, tmp_path):
    where, src = str(tmp_path), tmp_path / "src"
    src.mkdir()
    for name in "abc":
        (src / f"{name}.md").write_text(name)
    S.record_listing(spark, str(src), f"{where}/listings", 1, "*.md")
    assert run(spark, where) == ["a", "b", "c"]
    (src / "b.md").unlink()
    (src / "c.md").write_text("c longer")
    (src / "d.md").write_text("d")
    S.record_listing(spark, str(src), f"{where}/listings", 2, "*.md")
    assert run(spark, where) == ["a", "c longer", "d"]
    told = events(spark, where)
    assert [e for e in told if e[1] == 2] == [("b.md", 2, "removed"), ("c.md", 2, "modified"), ("d.md", 2, "new")]
    assert run(spark, where) == ["a", "c longer", "d"] and events(spark, where) == told
    # one comes back, older than it was, and another goes
    (src / "b.md").write_text("b again")
    os.utime(src / "b.md", (1e9, 1e9))
    (src / "a.md").unlink()
    S.record_listing(spark, str(src), f"{where}/listings", 3, "*.md")
    assert run(spark, where) == ["b again", "c longer", "d"]


def test_listings_in_pieces_and_out_of_order(spark, tmp_path):
    where = str(tmp_path)

    def listing(number, paths, part=None):
        """Rows of listing ``number``; ``part`` says which of them come now."""
        rows = [(number, 0, p, n, datetime(2024, 1, 1) if p else None, len(paths) + 1) for p, n in [(None, None), *paths]]
        chosen = rows if part is None else [rows[i] for i in part]
        spark.createDataFrame(chosen, S.LISTING).write.mode("append").parquet(f"{where}/listings")

    def told():
        query = S.stream_refresh(spark, f"{where}/listings", f"{where}/events", f"{where}/state")
        query.awaitTermination(240)
        assert query.exception() is None
        return events(spark, where)

    listing(1, [("x", 1), ("y", 1), ("z", 1)])
    want = [("x", 1, "new"), ("y", 1, "new"), ("z", 1, "new")]
    assert told() == want
    listing(3, [("x", 2), ("w", 1)], [0, 2])  # without the row of x
    assert told() == want
    listing(3, [("x", 2), ("w", 1)], [1])
    want = sorted([*want, ("w", 3, "new"), ("x", 3, "modified"), ("y", 3, "removed"), ("z", 3, "removed")])
    assert told() == want
    listing(2, [("x", 1), ("y", 1), ("z", 1)])  # late: a newer one is known
    assert told() == want
    listing(4, [])
    assert told() == sorted([*want, ("x", 4, "removed"), ("w", 4, "removed")])
