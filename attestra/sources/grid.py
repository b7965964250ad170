"""Raw cell grids: trimming, header detection, row blocks and formula gaps.

Cells are long rows (doc_id, sheet, r, c, v, kind, fmt, formula), r and c from 1. A sheet may be any
share of all cells, so every step aggregates by sheet or by sheet row before it joins; nothing
gathers a sheet into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.anchors import col_letter, sheet_ref
from attestra.functions.text import strip
from attestra.session import durable

# fixed values: how far down a header is looked for
HEADER_SCAN_ROWS = 25
WIDTH_SCAN_ROWS = 50
ROWS_BELOW = 3
SHEET = ["doc_id", "sheet"]
SENT_SHEETS = 200_000  # extents of at most so many sheets are sent to every task; more are joined by shuffling
ROW_SPACE = 1 << 21  # more rows than a sheet can have; spaces the block numbers of consecutive sheets


def is_blank(v: Column) -> Column:
    return F.coalesce(strip(v) == "", F.lit(True))


def sheet_extent(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, n_rows, n_cols of the non-blank part; sheets without any are left out."""
    return cells.filter(~is_blank(F.col("v"))).groupBy(*SHEET).agg(
        F.max("r").cast("long").alias("n_rows"), F.max("c").cast("long").alias("n_cols")
    )


def trim_grid(cells: DataFrame) -> DataFrame:
    """Cells inside the extent of their sheet: trailing blank rows and columns and empty sheets are gone."""
    size = durable(sheet_extent(cells))
    # a row per sheet: up to so many go to every task, and no task sorts cells
    inside = cells.join(F.broadcast(size) if size.count() <= SENT_SHEETS else size, SHEET)
    return inside.filter((F.col("r") <= F.col("n_rows")) & (F.col("c") <= F.col("n_cols")))


def detect_header(cells: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """doc_id, sheet, header_row (null if none): at most the first 50 rows of a sheet are looked at."""
    top = cells.filter((F.col("r") <= WIDTH_SCAN_ROWS) & ~is_blank(F.col("v")))
    rows = top.groupBy(*SHEET, "r").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") != "s").alias("n_other")
    )
    w = Window.partitionBy(*SHEET)
    below = w.orderBy("r").rangeBetween(1, ROWS_BELOW)
    scored = rows.withColumns({"width": F.max("n").over(w), "below": F.count("*").over(below)})
    fits = (
        (F.col("r") <= HEADER_SCAN_ROWS)
        & (F.col("n") >= 2)
        & (F.col("n_other") == 0)
        & (F.col("n") >= 0.5 * F.col("width"))
        & (F.col("below") > 0)
    )
    found = scored.groupBy(*SHEET).agg(F.min(F.when(fits, F.col("r"))).cast("long").alias("header_row"))
    out = sheet_extent(cells).select(*SHEET).join(found, SHEET, "left")
    if overrides is None:
        return out
    named = overrides.select(*SHEET, F.col("header_row").cast("long").alias("_given"))
    return out.join(named, SHEET, "left").select(
        *SHEET, F.coalesce("_given", "header_row").alias("header_row")
    )


def table_body(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Cells of each sheet's table: below its header row (``detect_header`` unless given) and inside its extent.

    Sheets without a header have no table. What decides is a row per sheet, so cells are not shuffled to be cut.
    """
    found = (detect_header(cells) if headers is None else headers).filter("header_row is not null")
    size = durable(sheet_extent(cells).join(found.select(*SHEET, "header_row"), SHEET))
    inside = (F.col("r") > F.col("header_row")) & (F.col("r") <= F.col("n_rows")) & (F.col("c") <= F.col("n_cols"))
    return cells.join(size, SHEET).filter(inside).drop("header_row", "n_rows", "n_cols")


def header_names(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per sheet: first data column, column count and the map column number to name."""
    extent = sheet_extent(cells).join(headers, SHEET)
    row = cells.join(headers.filter("header_row is not null"), SHEET).filter(
        (F.col("r") == F.col("header_row")) & ~is_blank(F.col("v"))
    )
    named = row.groupBy(*SHEET).agg(
        F.min("c").cast("long").alias("first"), F.map_from_entries(F.collect_list(F.struct("c", strip(F.col("v"))))).alias("given")
    )
    full = extent.join(named, SHEET, "left").withColumn("first", F.coalesce("first", F.lit(1).cast("long")))
    columns = F.transform(F.sequence("first", F.greatest("n_cols", "first")), lambda i: i.cast("int"))
    names = F.map_from_arrays(
        columns,
        F.transform(
            columns,
            lambda i: F.coalesce(F.try_element_at("given", i), F.concat(F.lit("col_"), col_letter(i))),
        ),
    )
    return full.select(*SHEET, "n_rows", "n_cols", "header_row", "first", names.alias("names"))


def formula_gaps(cells: DataFrame) -> DataFrame:
    """Cells that hold a formula but no calculated value, per sheet."""
    gap = F.col("v").isNull() & F.col("formula").startswith("=")
    return cells.filter(gap).groupBy(*SHEET).agg(F.count("*").alias("n_gaps"))


def sheet_blocks(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Blocks of sheets: a summary, the rows above the header, one 'name: value' block per data row.

    Block numbers leave room for every possible row, so no running count over a sheet is needed.
    """
    names = header_names(cells, headers)
    data = cells.filter(~is_blank(F.col("v")))
    rows = data.groupBy(*SHEET, "r").agg(F.array_sort(F.collect_list(F.struct("c", strip(F.col("v")).alias("v")))).alias("vs"))
    rows = rows.join(names, SHEET)
    above = F.col("header_row").isNotNull() & (F.col("r") < F.col("header_row"))
    body = F.col("header_row").isNull() | (F.col("r") > F.col("header_row"))
    kept = F.filter("vs", lambda x: x["c"] >= F.col("first"))
    shown = F.array_join(
        F.transform(kept, lambda x: F.concat(F.element_at("names", x["c"]), F.lit(": "), x["v"])), " | "
    )
    plain = F.array_join(F.transform("vs", lambda x: x["v"]), " | ")
    ref = sheet_ref(F.col("sheet"))
    r = F.col("r").cast("string")
    last = col_letter(F.col("n_cols"))
    left = F.when(above, "A").otherwise(col_letter(F.col("first")))
    blocks = rows.filter(above | (body & (F.size(kept) > 0))).select(
        *SHEET,
        F.col("r").cast("long").alias("r"),
        F.concat(ref, F.lit("!"), left, r, F.lit(":"), last, r).alias("anchor"),
        F.lit("row").alias("kind"),
        F.when(above, plain).otherwise(shown).alias("text"),
    )
    # numbers of rows only, not their cells
    below = data.select(*SHEET, "r").distinct().join(headers, SHEET)
    counts = below.groupBy(*SHEET).agg(F.count_if(body).alias("n_data"))
    gaps = formula_gaps(cells)
    info = names.join(counts, SHEET).join(gaps, SHEET, "left")
    where = F.when(
        F.col("header_row").isNotNull(), F.concat(F.lit(", header in row "), F.col("header_row").cast("string"))
    ).otherwise(", without a header row")
    warn = F.when(
        F.col("n_gaps") > 0,
        F.concat(
            F.lit(" Not calculated yet: "), F.col("n_gaps").cast("string"), F.lit(" formulas without a stored value."),
        ),
    ).otherwise("")
    summary = info.select(
        *SHEET,
        F.lit(0).cast("long").alias("r"),
        F.concat(ref, F.lit("!A1:"), last, F.col("n_rows").cast("string")).alias("anchor"),
        F.lit("sheet").alias("kind"),
        F.concat(
            F.col("sheet"), F.lit(" has "), F.col("n_data").cast("string"), F.lit(" rows of data in "),
            F.size("names").cast("string"), F.lit(" columns"), where, F.lit(": "),
            F.array_join(F.map_values("names"), ", "), F.lit("."), warn,
        ).alias("text"),
    )
    return blocks.unionByName(summary)
