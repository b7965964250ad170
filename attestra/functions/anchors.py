"""Anchors, references, sheet columns: the addresses of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: forms of references and anchors
REF = r"^([a-z0-9][a-z0-9._-]*)(?:#(.+))?$"
CELLS = r"^('(?:[^']|'')+'|[^!]+)!\$?([A-Z]{1,3})\$?(\d+)(?::\$?([A-Z]{1,3})\$?(\d+))?$"
LINES = r"^([LR])(\d+)(?:-([LR])(\d+))?$"


def parse_ref(c: Column) -> Column:
    """struct(doc, anchor, ok) of ``doc#anchor``; a leading ``@`` is allowed."""
    ref = F.ltrim(F.trim(c), F.lit("@"))
    ok = ref.rlike(REF)
    anchor = F.regexp_extract(ref, REF, 2)
    return F.struct(
        F.when(ok, F.regexp_extract(ref, REF, 1)).alias("doc"),
        F.when(ok & (anchor != ""), anchor).alias("anchor"),
        ok.alias("ok"),
    )


def parse_cells(anchor: Column) -> Column:
    """struct(sheet, r1, r2) of a cell or cell-range anchor, else null. Columns do not narrow a range."""
    sheet = F.regexp_extract(anchor, CELLS, 1)
    bare = F.regexp_replace(F.substring(sheet, 2, 2**30), "'$", "")
    name = F.when(sheet.startswith("'"), F.replace(bare, F.lit("''"), F.lit("'"))).otherwise(sheet)
    r1 = F.regexp_extract(anchor, CELLS, 3).try_cast("long")
    r2 = F.coalesce(F.regexp_extract(anchor, CELLS, 5).try_cast("long"), r1)
    return F.when(
        anchor.rlike(CELLS),
        F.struct(name.alias("sheet"), F.least(r1, r2).alias("lo"), F.greatest(r1, r2).alias("hi")),
    )


def parse_lines(anchor: Column) -> Column:
    """struct(form, lo, hi) of ``L10-L14`` or ``R7``, else null."""
    first, second = F.regexp_extract(anchor, LINES, 1), F.regexp_extract(anchor, LINES, 3)
    lo = F.regexp_extract(anchor, LINES, 2).try_cast("long")
    hi = F.coalesce(F.regexp_extract(anchor, LINES, 4).try_cast("long"), lo)
    ok = anchor.rlike(LINES) & ((second == "") | (second == first))
    return F.when(ok, F.struct(first.alias("form"), lo.alias("lo"), hi.alias("hi")))


def merge_anchor(first: Column, last: Column) -> Column:
    """One anchor for consecutive blocks: same sheet spans rows, everything else joins its two ends."""
    sheet = F.regexp_extract(first, r"(?s)^(.*)!", 1)
    a, b = F.regexp_extract(first, r"([^!]*)$", 1), F.regexp_extract(last, r"([^!]*)$", 1)
    cells = F.concat(sheet, F.lit("!"), F.substring_index(a, ":", 1), F.lit(":"), F.substring_index(b, ":", -1))
    lines = F.concat_ws("-", F.substring_index(first, "-", 1), F.substring_index(last, "-", -1))
    return (
        F.when(first == last, first)
        .when(first.contains("!") & last.contains("!"), cells)
        .when(first.startswith("L") & last.startswith("L"), lines)
        .otherwise(F.concat_ws("-", first, last))
    )


def col_letter(c: Column) -> Column:
    """1 to A, 27 to AA. Three letters cover every sheet; a fourth covers any 18-bit number."""
    n = c.cast("long")
    out = F.lit("")
    for _ in range(4):
        letter = F.chr((F.lit(65) + F.pmod(n - 1, F.lit(26))).cast("long"))
        out = F.when(n > 0, F.concat(letter, out)).otherwise(out)
        n = F.when(n > 0, F.floor((n - 1) / 26).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def col_index(c: Column) -> Column:
    """A to 1, AA to 27."""
    letters = F.filter(F.split(F.upper(c), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda acc, x: acc * 26 + (F.ascii(x) - 64))


def sheet_ref(c: Column) -> Column:
    """Sheet name as written in a reference, quoted unless it is a plain word."""
    quoted = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.rlike(r"^[A-Za-z0-9_.]+$"), c).otherwise(quoted)


def human_location(doc_type: Column, anchor: Column) -> Column:
    """An anchor in words a reader can follow in the original file."""
    get = lambda rx, g: F.regexp_extract(anchor, rx, g)
    page, slide = r"^page(\d+)(?:\.\d+)?$", r"^s(\d+)(?:\.(t|c)?(\d+|notes))?$"
    row, para, line = r"^t(\d+)(?:\.r(\d+))?$", r"^p(\d+)(?:-p(\d+))?$", r"^L(\d+)(?:-L(\d+))?$"
    part = (
        F.when(get(slide, 2) == "t", " (table)")
        .when(get(slide, 2) == "c", " (chart)")
        .when(anchor.endswith("notes"), " (notes)")
        .otherwise("")
    )
    second = lambda rx, lead: F.when(get(rx, 2) != "", F.concat(F.lit(lead), get(rx, 2))).otherwise("")
    sheet = F.btrim(F.regexp_extract(anchor, r"(?s)^(.*)!", 1), F.lit("'"))
    return (
        F.when(anchor.rlike(page), F.concat(F.lit("page "), get(page, 1)))
        .when((doc_type == "pptx") & anchor.rlike(slide), F.concat(F.lit("slide "), get(slide, 1), part))
        .when((doc_type == "docx") & anchor.rlike(row), F.concat(F.lit("table "), get(row, 1), second(row, ", row ")))
        .when((doc_type == "docx") & anchor.rlike(para), F.concat(F.lit("paragraph "), get(para, 1), second(para, "–")))
        .when(
            anchor.contains("!"),
            F.concat(F.lit("sheet "), sheet, F.lit(", cells "), F.regexp_extract(anchor, r"([^!]*)$", 1)),
        )
        .when(anchor.rlike(line), F.concat(F.lit("lines "), get(line, 1), second(line, "–")))
        .otherwise(anchor)
    )
