"""Delimited text whose delimiter is not known: a file as one row of text, or files of any size read in splits.

A split of a file may begin inside a quoted field, and only the quotes before it tell. So every split counts its quotes, the
counts are summed along the file (a number per split), and then every line knows whether it begins a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions.text import strip
from attestra.scale import pinned
from attestra.session import durable
from attestra.sources.blocks import row_text

DELIMITERS = [",", ";", "\t", "|"]  # fixed values, in order of preference
SNIFFED = 4096  # characters
RECORD = r"""(?:[^"\n]++|"[^"]*+")++"""


def _width(pattern: str):
    return lambda line: F.size(F.split(line, pattern))


def sniff(text: Column) -> Column:
    """The delimiter that splits most lines of the first 4,096 characters into as many fields as the first line."""
    lines = F.filter(F.split(F.substring(text, 1, SNIFFED), "\r?\n"), lambda x: F.trim(x) != "")
    best = F.struct(F.lit(0).alias("score"), F.lit(0).alias("rank"), F.lit(",").alias("sep"))
    for i, sep in enumerate(DELIMITERS):
        pattern = "\\|" if sep == "|" else sep
        fields = F.transform(lines, _width(pattern))
        width = F.get(fields, F.lit(0))
        same = F.size(fields) - F.size(F.array_remove(fields, width))
        score = F.when(width > 1, same).otherwise(0)
        best = F.greatest(best, F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(sep).alias("sep")))
    return F.when(best["score"] > 0, best["sep"]).otherwise(",")


def split_record(record: Column, sep: Column) -> Column:
    """Fields of one record; quoted fields may hold delimiters, line breaks and doubled quotes."""
    guard = "\x02"
    # the delimiter becomes a control character outside quotes, so one pattern serves every file
    pieces = F.split(record, '"')
    marked = F.transform(
        pieces, lambda p, i: F.when(i % 2 == 0, F.replace(p, sep, F.lit(guard))).otherwise(p)
    )
    fields = F.split(F.array_join(marked, '"'), guard)
    bare = lambda x: F.when(
        x.rlike('(?s)^".*"$'), F.replace(F.regexp_replace(x, '(?s)^"|"$', ""), F.lit('""'), F.lit('"'))
    ).otherwise(x)
    return F.transform(fields, bare)


def read_delimited(files: DataFrame, key: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """doc_id, r, is_header, cells: non-blank records, numbered from 1; header blanks become ``col{i}``.

    Every row is cut or padded to the width of the header.
    """
    src = pinned(files.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")), "sep", sniff(F.col("_t")))
    clean = F.replace(F.col("_t"), F.lit("\r\n"), F.lit("\n"))
    records = F.regexp_extract_all(clean, F.lit(RECORD), F.lit(0))
    rows = F.filter(
        F.transform(records, lambda rec: split_record(rec, F.col("sep"))),
        lambda cells: F.exists(cells, lambda v: strip(v) != ""),
    )
    parsed = pinned(src, "rows", rows).select("doc_id", "rows")
    parsed = parsed.withColumn("header", _header(F.get("rows", F.lit(0))))
    out = parsed.select("doc_id", "header", F.posexplode("rows").alias("i", "cells"))
    return _fitted(out.withColumn("r", F.col("i") + 1))


def _header(cells: Column) -> Column:
    return F.transform(cells, lambda h, i: F.when(strip(h) == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(strip(h)))


def _fitted(rows: DataFrame) -> DataFrame:
    pad = F.array_repeat(F.lit(""), F.greatest(F.size("header") - F.size("cells"), F.lit(0)))
    fitted = F.slice(F.concat("cells", pad), F.lit(1), F.size("header"))
    first = F.col("r") == 1
    return rows.select("doc_id", "r", first.alias("is_header"), "header", "cells", F.when(first, F.col("header")).otherwise(fitted).alias("fitted"))


def read_split_lines(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """(doc_id, start, id, line) of text files: the path, where the split of the file begins, and the order of lines in it."""
    raw = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line")
    )


def split_records(lines: DataFrame) -> DataFrame:
    """(doc_id, start, id, record): the records of :func:`read_split_lines`, each under the line it begins in.

    What a window sees is one split. Records of one line, nearly all, are not shuffled again; the lines of longer ones
    meet under the line that begins them, in whichever split that is. A last quote that nothing closes ends its record, as
    in the reading of a whole text.
    """
    quotes = F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))
    within = Window.partitionBy("doc_id", "start").orderBy("id")
    along = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.withColumn("q", quotes.cast("long"))
    splits = counted.groupBy("doc_id", "start").agg(F.sum("q").alias("q"))
    splits = splits.select("doc_id", "start", F.coalesce(F.sum("q").over(along), F.lit(0)).alias("before"), F.sum("q").over(Window.partitionBy("doc_id")).alias("total"))
    run = counted.withColumn("run", F.coalesce(F.sum("q").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = run.join(splits, ["doc_id", "start"]).withColumn("at", F.col("before") + F.col("run"))
    # what stands behind the last quote of a file with an odd number of them is outside
    begins = (F.col("at") == F.col("total")) | (F.col("at") % 2 == 0)
    end = F.col("at") + F.col("q")
    dangling = (F.col("q") > 0) & (end == F.col("total")) & (F.col("total") % 2 == 1)
    closed = (end == F.col("total")) | (end % 2 == 0)
    marked = run.withColumns({"begins": begins, "closed": closed, "line": F.when(dangling, F.regexp_replace("line", '(?s)"([^"]*)$', "\n$1")).otherwise(F.col("line")), "dangling": dangling})
    marked = marked.withColumn("own", F.last(F.when(F.col("begins"), F.col("id")), ignorenulls=True).over(within))
    marked = durable(marked.select("doc_id", "start", "id", "line", "begins", "closed", "dangling", "own"))
    single = marked.filter("begins and closed").select("doc_id", "start", "id", F.col("line").alias("record"), "dangling")
    # lines at the beginning of a split may belong to a record of an earlier one
    last = marked.groupBy("doc_id", "start").agg(F.max("own").alias("last"))
    last = last.select("doc_id", "start", F.last("last", ignorenulls=True).over(along).alias("earlier"))
    parts = marked.filter("not (begins and closed)").join(last, ["doc_id", "start"]).withColumn("own", F.coalesce("own", "earlier"))
    pieces = F.array_sort(F.collect_list(F.struct("start", "id", "line")))
    longer = parts.groupBy("doc_id", "own").agg(F.min(F.struct("start", "id"))["start"].alias("start"), F.array_join(F.transform(pieces, lambda x: x["line"]), "\n").alias("record"), F.bool_or("dangling").alias("dangling"))
    whole = single.unionByName(longer.withColumnRenamed("own", "id"))
    # a quote that nothing closes divides its record in two at its last place outside quotes
    cut = F.when(F.col("dangling"), F.regexp_extract_all("record", F.lit(RECORD), F.lit(0))).otherwise(F.array("record"))
    return whole.select("doc_id", "start", "id", F.posexplode(cut).alias("k", "record"))


def read_delimited_files(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """The rows of :func:`read_delimited` (``doc_id`` is the path) for files of any size; each is read in splits by many tasks."""
    lines = durable(read_split_lines(spark, paths, glob))
    within = Window.partitionBy("doc_id", "start").orderBy("id")
    size = F.sum(F.length("line") + 1).over(within.rowsBetween(Window.unboundedPreceding, -1))
    head = lines.filter("start = 0").withColumn("used", F.coalesce(size, F.lit(0))).filter(F.col("used") < SNIFFED)
    parts = F.array_sort(F.collect_list(F.struct("id", F.substring("line", 1, SNIFFED).alias("line"))))
    seps = head.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("t"))
    seps = durable(seps.select("doc_id", sniff(F.col("t")).alias("sep")))
    rows = split_records(lines).join(seps, "doc_id").select("doc_id", "start", "id", "k", split_record(F.col("record"), F.col("sep")).alias("cells"))
    rows = durable(rows.filter(F.exists("cells", lambda v: strip(v) != "")))
    # numbers along the file: those of the splits before, then the place within the split
    along = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("doc_id", "start").agg(F.count("*").alias("n"))
    sizes = sizes.select("doc_id", "start", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("doc_id", "start").orderBy("id", "k"))
    numbered = durable(rows.withColumn("_n", place).join(sizes, ["doc_id", "start"]).select("doc_id", (F.col("before") + F.col("_n")).cast("long").alias("r"), "cells"))
    heads = numbered.filter("r = 1").select("doc_id", _header(F.col("cells")).alias("header"))
    return _fitted(numbered.join(heads, "doc_id"))


def delimited_blocks(rows: DataFrame, section: Column | None = None) -> DataFrame:
    """Blocks ``R{n}`` of the records: the column list, then 'name: value' rows."""
    head = F.concat(F.lit("Columns: "), F.array_join("header", ", "))
    return rows.select(
        "doc_id",
        (F.col("r") - 1).alias("seq"),
        F.concat(F.lit("R"), F.col("r").cast("string")).alias("anchor"),
        F.lit("row").alias("kind"),
        (section if section is not None else F.lit("")).alias("section"),
        F.when(F.col("is_header"), head).otherwise(row_text(F.col("header"), F.col("cells"))).alias("text"),
    )


def empty_files(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return files.filter(strip(F.col(text)) == "").select(F.col(key).alias("doc_id"), F.lit("empty CSV").alias("warning"))
