"""Citations in written text: ``[@doc#anchor "quote"; @calc:7]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.text import strip

# --- fixed values: the citation syntax -------------------------------------------------------------
GROUP = r"\[@([^\]\n]+)\]"
ITEM = r"""(?U)^\s*+@?((?:[^\s"'“”;]++|'[^']*+')++)(?:\s++["“]([^"”]*+)["”])?\s*$"""  # possessive: long items must not nest
ITEMS = r"""(?:[^;"“]++|["“][^"”]*+(?:["”]|$))++"""  # a semicolon inside quotes does not part items
CITE_AFTER_STOP = r"(?U)([.!?])\s*(\[@[^\]\n]+\](?:\s*\[@[^\]\n]+\])*)"
SENTENCE_BREAK = r"""(?U)(?<=[.!?])\s+(?=["“(\[A-Z0-9À-Ỹ*_])"""
# ---------------------------------------------------------------------------------------------------

CITATION = "struct<ref:string,quote:string,item:string,ok:boolean>"


def parse_citations(c: Column) -> Column:
    """Array of struct(ref, quote, item, ok) in order; malformed items have ok = false."""
    bodies = F.regexp_extract_all(c, F.lit(GROUP), F.lit(1))
    items = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(ITEMS), F.lit(0))))
    items = F.filter(F.transform(items, strip), lambda i: i != "")

    # two steps, so that the pattern is tried once for each part; an item of the right form has a reference
    def parts(i: Column) -> Column:
        return F.struct(i.alias("item"), F.regexp_extract(i, ITEM, 1).alias("ref"), F.regexp_extract(i, ITEM, 2).alias("quote"))

    def one(p: Column) -> Column:
        ref = p["ref"]
        ok = (ref != "") & (~ref.startswith("calc:") | ref.rlike(r"^calc:\d+$"))
        return F.struct(
            F.when(ok, ref).alias("ref"), F.when(ok, F.nullif(p["quote"], F.lit(""))).alias("quote"), p["item"].alias("item"), ok.alias("ok")
        ).cast(CITATION)

    return F.when(c.contains("[@"), F.transform(F.transform(items, parts), one)).otherwise(F.array().cast(f"array<{CITATION}>"))


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(c, GROUP, "")


def group_texts(c: Column) -> Column:
    """The citation groups of a line as one text."""
    return F.array_join(F.regexp_extract_all(c, F.lit(GROUP), F.lit(0)), " ")


def split_sentences(unit: Column) -> Column:
    """Sentences of a statement; a citation after a full stop belongs to the sentence before, table rows stay whole."""
    moved = F.regexp_replace(unit, CITE_AFTER_STOP, " $2$1")
    parts = F.filter(F.split(moved, SENTENCE_BREAK), lambda p: strip(p) != "")
    return F.when(unit.startswith("|"), F.array(unit)).otherwise(parts)


def borrow(own: Column) -> Column:
    """Per sentence its own citations, else those of the next sentence that has some, else of the nearest before.

    Works on the array of a statement's sentences, so no rows are shuffled.
    """
    some = lambda x: F.size(x) > 0
    none = F.array().cast(f"array<{CITATION}>")

    def pick(mine: Column, i: Column) -> Column:
        later = F.get(F.filter(F.slice(own, i + 2, F.size(own)), some), F.lit(0))
        before = F.try_element_at(F.filter(F.slice(own, F.lit(1), i), some), F.lit(-1))
        return F.when(some(mine), mine).otherwise(F.coalesce(later, before, none))

    return F.transform(own, pick)
