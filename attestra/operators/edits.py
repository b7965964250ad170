"""Edits as table operations: cells, find and replace, appended blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.anchors import col_index

# fixed value: form of a cell to set
CELL = r"^(?:('(?:[^']|'')+'|[^!]+)!)?\$?([A-Z]{1,3})\$?(\d+)$"


def parse_edits(edits: DataFrame, default_sheet: str | None = None) -> DataFrame:
    """Edits (doc_id, ref, value) with sheet, r, c and ok."""
    sheet = F.regexp_extract("ref", CELL, 1)
    bare = F.replace(F.regexp_replace(sheet, "^'|'$", ""), F.lit("''"), F.lit("'"))
    named = F.when(sheet != "", bare).otherwise(F.lit(default_sheet))
    return edits.select(
        "doc_id", "ref", "value", *(c for c in edits.columns if c == "_at"),
        F.trim("ref").rlike(CELL).alias("ok"),
        named.alias("sheet"),
        F.regexp_extract("ref", CELL, 3).try_cast("int").alias("r"),
        col_index(F.regexp_extract("ref", CELL, 2)).cast("int").alias("c"),
    )


def apply_cell_edits(
    cells: DataFrame, edits: DataFrame, default_sheet: str | None = None, order: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells after, changes old to new, refused edits with the reason). New cells may be set.

    Of several edits of one cell the last in ``order`` (a column of ``edits``; without it, by reference and value) holds.
    Edits that name no sheet go to ``default_sheet``. Cells keep all their columns; an edited one loses its
    formula and format, and its kind is that of a number or of text.
    """
    place = edits[order] if order else F.lit(0)
    keyed = edits.select("doc_id", "ref", "value", place.alias("_at"))
    parsed = parse_edits(keyed.select("doc_id", "ref", "value", "_at"), default_sheet)
    sheets = cells.select("doc_id", "sheet").distinct()
    bad = parsed.filter("not ok").select("doc_id", "ref", F.lit("bad cell reference").alias("reason"))
    homeless = parsed.filter("ok").join(sheets, ["doc_id", "sheet"], "left_anti")
    refused = bad.unionByName(homeless.select("doc_id", "ref", F.lit("no such sheet").alias("reason")))
    key = ["doc_id", "sheet", "r", "c"]
    good = parsed.filter("ok").join(sheets, ["doc_id", "sheet"], "left_semi")
    good = good.groupBy(*key).agg(F.max(F.struct("_at", "ref", "value")).alias("_last")).select(*key, F.col("_last.value").alias("value"), F.lit(True).alias("_set"))
    both = cells.join(good, key, "full")
    typed = F.when(F.col("value").isNull(), None).when(F.col("value").try_cast("double").isNotNull(), "f").otherwise("s")
    new = {"v": F.col("value"), "kind": typed}
    rest = [c for c in cells.columns if c not in key]
    after = both.select(*key, *(F.when(F.col("_set"), new.get(c, F.lit(None))).otherwise(F.col(c)).alias(c) for c in rest))
    changes = both.filter("_set").select("doc_id", "sheet", "r", "c", F.col("v").alias("old"), F.col("value").alias("new"))
    return after, changes, refused


def occurrences(text: Column, find: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))) / len(find)).cast("long")


def replace_text(blocks: DataFrame, find: str, repl: str, text: str = "text") -> DataFrame:
    """Changed blocks with ``n`` replaced occurrences; blocks without any are not written. One left-to-right pass."""
    if not find:
        raise ValueError("find must not be empty")
    n = occurrences(F.col(text), find)
    counted = blocks.filter(F.col(text).contains(find)).withColumn("n", n)
    return counted.withColumn(text, F.replace(F.col(text), F.lit(find), F.lit(repl)))


def append_blocks(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Blocks of ``extra`` (doc_id, seq, …) after the last block of the document they go to."""
    last = base.groupBy("doc_id").agg((F.max("seq") + 1).alias("_from"))
    moved = extra.join(last, "doc_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_from", F.lit(0))).drop("_from")
    return base.unionByName(moved.select(*base.columns))
