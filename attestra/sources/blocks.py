"""Text documents to addressable blocks.

A document is one row, so everything ordered within it (line windows below) is bounded by the size
of that one row; no window here spans documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import strip

# fixed values: line forms
HEADING = r"(?U)^(#{1,6})\s+(.*?)\s*#*\s*$"
TABLE_RULE = r"(?U)^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$"
LIST_ITEM = r"(?U)^\s*([-*+]|\d+[.)])\s"
KEPT_META = ["url", "fetched_at", "source", "title", "author", "date"]


def row_text(header: Column, values: Column) -> Column:
    """'name: value | name: value' of one row; blank values are left out, unnamed columns are numbered."""
    named = F.transform(
        values,
        lambda v, i: F.when(
            strip(v) != "",
            F.concat(
                F.coalesce(F.nullif(F.get(header, i), F.lit("")), F.concat(F.lit("col"), (i + 1).cast("string"))),
                F.lit(": "),
                strip(v),
            ),
        ),
    )
    return F.array_join(F.filter(named, lambda x: x.isNotNull()), " | ")


def pipe_cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), strip)


def front_matter(text: Column) -> Column:
    """struct(meta map, skip): ``key: value`` lines between two ``---`` lines at the top, if closed by line 60."""
    lines = F.slice(F.split(text, "\n", 61), 1, 60)
    bare = F.transform(lines, strip)
    close = F.array_position(F.slice(bare, 2, 60), "---").cast("int")
    opened = (bare[0] == "---") & (close > 0)
    body = F.filter(F.slice(lines, F.lit(2), F.greatest(close - 1, F.lit(0))), lambda x: x.contains(":"))
    pairs = F.transform(
        body,
        lambda x: F.struct(
            strip(F.substring_index(x, ":", 1)).alias("k"),
            F.btrim(strip(F.regexp_replace(x, r"(?s)^[^:]*:", "")), F.lit('"')).alias("v"),
        ),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(
        F.when(opened, F.map_from_arrays(keys, last)).otherwise(empty).alias("meta"),
        F.when(opened, close + 1).otherwise(0).alias("skip"),
    )


def line_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every non-blank line is one block ``L{n}``: a narrow job, nothing is shuffled."""
    src = docs.select(F.col(key).alias("doc_id"), F.split(text, "\n").alias("ls"))
    lines = src.select("doc_id", F.size("ls").alias("n_lines"), F.posexplode("ls").alias("seq", "line"))
    return lines.select(
        "doc_id",
        "n_lines",
        "seq",
        F.concat(F.lit("L"), (F.col("seq") + 1).cast("string")).alias("anchor"),
        F.lit("line").alias("kind"),
        F.lit("").alias("section"),
        strip(F.col("line")).alias("text"),
    ).filter("text != ''")


def _lines(docs: DataFrame, key: str, text: str, markdown: bool) -> DataFrame:
    skip = front_matter(F.col(text))["skip"] if markdown else F.lit(0)
    src = docs.select(F.col(key).alias("doc_id"), skip.alias("skip"), F.split(text, "\n").alias("lines"))
    size = F.size("lines").alias("n_lines")
    rows = src.select("doc_id", "skip", size, F.posexplode("lines").alias("i", "line")).filter(F.col("i") >= F.col("skip"))
    return rows.select("doc_id", "n_lines", (F.col("i") + 1).alias("ln"), "line", strip(F.col("line")).alias("bare"))


def with_sections(df: DataFrame, key: str, pos: str, level: str, title: str) -> DataFrame:
    """Add ``section``: titles of the headings a row stands under, outermost first.

    A heading is live while no later heading of the same or a lower level number follows; with one
    running latest-heading per level that is a comparison of positions.
    """
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns(
        {
            f"_h{n}": F.max(F.when(F.col(level) == n, F.struct(F.col(pos).alias("p"), F.col(title).alias("t")))).over(w)
            for n in range(1, 7)
        }
    )
    titles = []
    for n in range(1, 7):
        mine = F.col(f"_h{n}.p")
        above = [F.coalesce(F.col(f"_h{k}.p"), F.lit(-1)) for k in range(1, n)]
        live = mine > F.greatest(*above, F.lit(-1)) if len(above) > 0 else mine.isNotNull()
        titles.append(F.when(live, F.col(f"_h{n}.t")))
    return df.withColumn("section", F.concat_ws(" > ", *titles)).drop(*[f"_h{n}" for n in range(1, 7)])


def segment_text(docs: DataFrame, key: str = "doc_id", text: str = "text", markdown: bool = True) -> DataFrame:
    """Headings, paragraphs, lists and pipe tables as blocks with line anchors.

    Blank lines end a block unless inside a code fence; headings count outside fences only. Without
    ``markdown`` headings are plain paragraphs. Columns: doc_id, n_lines (of the document), seq, anchor,
    kind, section, text, level, header, rows (the last two for pipe tables).
    """
    w = Window.partitionBy("doc_id").orderBy("ln")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = _lines(docs, key, text, markdown)
    lines = lines.withColumn("fences", F.sum(F.when(F.col("bare").startswith("```"), 1).otherwise(0)).over(run))
    in_code = F.col("fences") % 2 == 1
    head = ~in_code & F.col("line").rlike(HEADING)
    lines = lines.withColumns(
        {
            "level": F.when(head, F.length(F.regexp_extract("line", HEADING, 1))),
            "title": F.when(head, strip(F.regexp_extract("line", HEADING, 2))),
            "body": ~head & ((F.col("bare") != "") | in_code),
        }
    )
    opens = F.col("level").isNotNull() | (F.col("body") & ~F.coalesce(F.lag("body").over(w), F.lit(False)))
    lines = lines.withColumn("block", F.sum(F.when(opens, 1).otherwise(0)).over(run))
    lines = with_sections(lines, "doc_id", "ln", "level", "title")
    lines = lines.filter(F.col("body") | F.col("level").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("ln", "line")))
    blocks = lines.groupBy("doc_id", "n_lines", "block").agg(
        F.min("ln").alias("first"),
        F.max("ln").alias("last"),
        F.max("level").alias("level"),
        F.max("title").alias("title"),
        F.max("section").alias("section"),
        F.transform(parts, lambda x: x["line"]).alias("ls"),
    )
    table = (F.size("ls") >= 3) & F.get("ls", F.lit(0)).contains("|") & F.coalesce(
        F.get("ls", F.lit(1)).rlike(TABLE_RULE), F.lit(False)
    )
    table = table & F.col("level").isNull()
    blocks = blocks.withColumns(
        {
            "header": F.when(table, pipe_cells(F.get("ls", F.lit(0)))),
            "rows": F.when(
                table, F.transform(F.filter(F.slice("ls", 3, 2**30), lambda x: x.contains("|")), pipe_cells)
            ),
        }
    )
    kind = (
        F.when(F.col("level").isNotNull(), "heading" if markdown else "para")
        .when(F.col("header").isNotNull(), "table_row")
        .when(F.get("ls", F.lit(0)).rlike(LIST_ITEM), "list")
        .otherwise("para")
    )
    shown = F.concat(
        F.array_join("header", " | "),
        F.when(F.size("rows") > 0, "\n").otherwise(""),
        F.array_join(F.transform("rows", lambda r: row_text(F.col("header"), r)), "\n"),
    )
    plain = strip(F.array_join("ls", "\n"))
    span = F.concat(F.lit("L"), F.col("first").cast("string"))
    return blocks.select(
        "doc_id",
        "n_lines",
        (F.col("block") - 1).cast("int").alias("seq"),
        F.when(F.col("first") == F.col("last"), span)
        .otherwise(F.concat(span, F.lit("-L"), F.col("last").cast("string")))
        .alias("anchor"),
        kind.alias("kind"),
        "section",
        F.when(F.col("level").isNotNull(), F.col("title")).when(F.col("header").isNotNull(), shown).otherwise(plain)
        .alias("text"),
        "level",
        "header",
        "rows",
    )


def pipe_table_cells(blocks: DataFrame) -> DataFrame:
    """Pipe tables of ``segment_text`` as cells: the header is row 1, the sheet name says where the table stands."""
    tables = blocks.filter(F.col("header").isNotNull())
    grid = F.concat(F.array(F.col("header")), F.col("rows"))
    name = F.concat(F.lit("Table at line "), F.regexp_extract("anchor", r"^L(\d+)", 1))
    rows = tables.select("doc_id", name.alias("sheet"), "anchor", F.posexplode(grid).alias("r", "cells"))
    cells = rows.select("doc_id", "sheet", "anchor", (F.col("r") + 1).alias("r"), F.posexplode("cells").alias("c", "v"))
    return cells.select("doc_id", "sheet", "anchor", "r", (F.col("c") + 1).alias("c"), "v")


def rejoin_wrapped(c: Column) -> Column:
    """Cell text broken by a narrow column: a short lower-case tail belongs to the word before it."""
    # fixed values: short words that are words of their own
    words = "a|of|in|to|at|on|by|or|is|it|an|as|be|we|up|no|so|do|if|vs"
    joined = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?<=[a-z])\n(?!(?:{words})\b)(?=[a-z]{{1,2}}\b)", "")
    return strip(F.replace(joined, F.lit("\n"), F.lit(" ")))


def empty_units(units: DataFrame, key: str, number: str, text: str, shown: int = 20) -> DataFrame:
    """Per document: how many pages hold no text, and the first ``shown`` numbers of them."""
    blank = units.filter(strip(F.coalesce(F.col(text), F.lit(""))) == "").select(key, number)
    counts = blank.groupBy(key).agg(F.count("*").alias("n_empty"))
    first = blank.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(number))).filter(
        F.col("rn") <= shown
    )
    lists = first.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(number)), lambda x: x.cast("string")), ", ").alias("first")
    )
    return counts.join(lists, key)


def reading_order(shapes: DataFrame) -> DataFrame:
    """Slide text: title first, then shapes from top to bottom and left to right, paragraphs as indented bullets."""
    txt = strip(F.replace(F.col("text"), F.lit("\v"), F.lit(" ")))
    shown = F.when(F.col("is_title"), txt).otherwise(
        F.concat(F.repeat(F.lit("  "), F.coalesce(F.col("level"), F.lit(0))), F.lit("- "), txt)
    )
    lines = shapes.withColumn("line", F.when(txt != "", shown))
    order = F.struct(
        (~F.col("is_title")).alias("t"),
        F.coalesce(F.col("top"), F.lit(0)).alias("top"),
        F.coalesce(F.col("left"), F.lit(0)).alias("left"),
        "shape",
        "para",
        "line",
    )
    slides = lines.groupBy("doc_id", "slide").agg(
        F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), order))).alias("ls"),
        F.max(F.when(F.col("is_title"), F.nullif(txt, F.lit("")))).alias("title"),
    )
    number = F.col("slide").cast("string")
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return slides.select(
        "doc_id",
        "slide",
        F.concat(F.lit("s"), number).alias("anchor"),
        F.lit("slide").alias("kind"),
        F.coalesce("title", F.concat(F.lit("Slide "), number)).alias("section"),
        F.when(F.size("ls") == 0, F.concat(F.lit("(slide "), number, F.lit(" has no text)"))).otherwise(text).alias("text"),
    )
