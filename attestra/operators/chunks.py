"""Blocks to retrieval chunks, long pages to parts, and document ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.anchors import merge_anchor
from attestra.functions.text import slugify, strip
from attestra.operators.packing import TILE, pack
from attestra.scale import pinned, rank_within
from attestra.sources.blocks import line_blocks

# fixed values
CHUNK_CHARS = 1800
PAGE_CHARS = 3000


def _gather(groups: DataFrame, anchor) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return groups.agg(
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        anchor.alias("anchor"),
        F.min_by("section", "seq").alias("section"),
        F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"),
    )


def make_chunks(blocks: DataFrame, chunk_chars: int = CHUNK_CHARS, n_blocks: str | None = None) -> DataFrame:
    """Consecutive blocks as chunks that respect structure.

    ``blocks`` needs doc_id, doc_type, seq, anchor, kind, section, text and, for sheets and slides,
    sheet and slide. Slide decks give one chunk per slide, pdf pages one per block; elsewhere a chunk
    ends before a heading, a sheet, or the block that would make it too long, and a sheet summary
    stands alone. ``n_blocks`` may name a column above every seq of the document (blocks of text bring
    n_lines); without one long documents are found by an aggregate.
    """
    have = set(blocks.columns)
    full = blocks
    for name, typ in (("sheet", "string"), ("slide", "int"), ("doc_type", "string")):
        if name not in have:
            full = full.withColumn(name, F.lit(None).cast(typ))
    if n_blocks is None and "n_lines" in have:
        n_blocks = "n_lines"
    if n_blocks is None:
        top = full.groupBy("doc_id").agg((F.max("seq") + 1).alias("_n"))
        full = full.join(top, "doc_id")
        n_blocks = "_n"
    decks = full.filter("doc_type = 'pptx'")
    pages = full.filter("doc_type = 'pdf'")
    rest = full.filter("doc_type is null or doc_type not in ('pptx', 'pdf')")
    # a change of sheet always starts a chunk, so each sheet is packed on its own
    sheets = rest.withColumn("_key", F.struct("doc_id", F.coalesce("sheet", F.lit("")).alias("sheet")))
    packed = pack(
        sheets.withColumn("_len", F.length("text")),
        "_key",
        "seq",
        "_len",
        chunk_chars,
        n_blocks,
        opens=F.col("kind").isin("heading", "sheet"),
        closes=F.col("kind") == "sheet",
        carry=["anchor", "section", "text"],
    )
    ends = merge_anchor(F.min_by("anchor", "seq"), F.max_by("anchor", "seq"))
    cols = ["doc_id", "first_seq", "last_seq", "anchor", "section", "text"]
    chunks = _gather(packed.groupBy(F.col("_key.doc_id").alias("doc_id"), "_key.sheet", "start"), ends).select(*cols)
    slide_anchor = F.concat(F.lit("s"), F.first("slide").cast("string"))
    chunks = chunks.unionByName(_gather(decks.groupBy("doc_id", "slide"), slide_anchor).select(*cols))
    single = pages.select(
        "doc_id", F.col("seq").cast("long").alias("first_seq"), F.col("seq").cast("long").alias("last_seq"), "anchor", "section", "text"
    )
    return chunks.unionByName(single)


def line_chunks(
    docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, carry=(), tile: int = TILE
) -> DataFrame:
    """``make_chunks`` of the non-blank lines of documents, with columns of the document carried along.

    The lines of a document are in one row, so documents of up to ``tile`` lines are folded where they
    are and nothing is shuffled; only longer ones go the way of packed sequences.
    """
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), *carry)
    n_lines = F.size(F.split("_text", "\n"))
    line = lambda x, i: F.struct(i.cast("long").alias("seq"), strip(x).alias("t"))
    kept = F.filter(F.transform(F.split("_text", "\n"), line), lambda x: x["t"] != "")
    short = pinned(src.filter(n_lines <= tile), "_ls", kept)
    state = "struct<n:int,size:bigint,starts:array<int>>"

    def step(acc, x):
        fresh = (acc["size"] < 0) | (acc["size"] + F.length(x["t"]) > chunk_chars)
        return F.struct(
            (acc["n"] + 1).alias("n"),
            (F.when(fresh, 0).otherwise(acc["size"]) + F.length(x["t"]) + 1).alias("size"),
            F.when(fresh, F.concat(acc["starts"], F.array(acc["n"]))).otherwise(acc["starts"]).alias("starts"),
        ).cast(state)

    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("size"), F.array().cast("array<int>").alias("starts")).cast(state)
    cut = pinned(short, "_starts", F.aggregate("_ls", zero, step)["starts"])
    ends = F.concat(F.slice("_starts", F.lit(2), F.greatest(F.size("_starts"), F.lit(1))), F.array(F.size("_ls")))
    part = lambda a, b: F.slice("_ls", a + 1, b - a)
    rows = cut.select("doc_id", *carry, F.explode(F.zip_with("_starts", ends, part)).alias("_part")).filter("_part is not null")
    first, last = F.get("_part", F.lit(0))["seq"], F.element_at("_part", -1)["seq"]
    address = lambda n: F.concat(F.lit("L"), (n + 1).cast("string"))
    small = rows.select(
        "doc_id",
        first.alias("first_seq"),
        last.alias("last_seq"),
        merge_anchor(address(first), address(last)).alias("anchor"),
        F.lit("").alias("section"),
        F.array_join(F.transform("_part", lambda x: x["t"]), "\n").alias("text"),
        *carry,
    )
    large = src.filter(n_lines > tile)
    packed = make_chunks(line_blocks(large, "doc_id", "_text"), chunk_chars)
    if carry:
        packed = packed.join(large.select("doc_id", *carry), "doc_id")
    return small.unionByName(packed.select(small.columns))


def split_long(pages: DataFrame, key: str, text: str, limit: int = PAGE_CHARS) -> DataFrame:
    """Pages over ``limit`` characters as parts of at most half of it, cut between lines; a longer line stays whole.

    Columns: key, part (from 1), n_parts, text.
    """
    src = pages.select(F.col(key), F.col(text).alias("_text"), F.split(text, "\n").alias("_ls"))
    short = src.filter(F.length("_text") <= limit)
    lines = src.filter(F.length("_text") > limit).select(
        key, F.size("_ls").alias("_n"), F.posexplode("_ls").alias("seq", "text")
    )
    packed = pack(lines.withColumn("_len", F.length("text")), key, "seq", "_len", limit // 2, "_n", carry=["text"])
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    parts = packed.groupBy(key, "start").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    # the parts of one page come from one row of text
    per_page = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("ps"))
    numbered = per_page.select(key, F.size("ps").alias("n_parts"), F.posexplode("ps").alias("i", "p"))
    long = numbered.select(key, (F.col("i") + 1).alias("part"), "n_parts", F.col("p.text").alias("text"))
    return long.unionByName(short.select(key, F.lit(1).alias("part"), F.lit(1).alias("n_parts"), F.col("_text").alias("text")))


def assign_doc_ids(new: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """(path, doc_id) for new files next to ``existing`` (doc_id): slug of the file stem, clashes made unique.

    The first file of a stem gets it, the next one stem-folder, then stem-2, stem-3 … in path order.
    Numbers skip ids that other files hold, found by joining candidates with all taken ids; a round
    gives every clashing file the next free number of its stem.
    """
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
    folder = F.get(
        F.reverse(F.split(path, "/")), F.lit(1)
    )
    base = slugify(stem)
    base = F.when(base.startswith("calc"), F.concat(F.lit("doc-"), base)).otherwise(base)
    parent = slugify(F.when(F.coalesce(folder, F.lit("")) == "", "root").otherwise(folder), "-", 20)
    files = new.select(F.col(path).alias("path"), base.alias("base"), parent.alias("parent"))
    held = existing.select(F.col("doc_id").alias("base"), F.lit(1).alias("held")).distinct()
    ranked = rank_within(files.join(held, "base", "left"), ["base"], ["path"], "nth")
    ranked = ranked.withColumn("nth", F.col("nth") + F.coalesce("held", F.lit(0)))
    taken = existing.select("doc_id").unionByName(ranked.filter("nth = 1").select(F.col("base").alias("doc_id"))).distinct()
    first = ranked.filter("nth = 1").select("path", F.col("base").alias("doc_id"))
    clash = ranked.filter("nth > 1").withColumn("want", F.concat("base", F.lit("-"), "parent"))
    by_folder = rank_within(clash, ["want"], ["path"], "k")
    free = by_folder.join(taken.withColumnRenamed("doc_id", "want").withColumn("t", F.lit(1)), "want", "left")
    gets = F.col("t").isNull() & (F.col("k") == 1)
    second = free.filter(gets).select("path", F.col("want").alias("doc_id"))
    rest = rank_within(free.filter(~gets).select("path", "base"), ["base"], ["path"], "m")
    # The m-th free number of a stem is m + 1 plus the held numbers below it. Holding number u (the j-th
    # held one) leaves u - 1 - j free below, so in one ranking of held and wanted numbers the place of
    # a wanted one tells its number.
    all_taken = taken.unionByName(second.select("doc_id")).distinct()
    numbered = r"^(.*)-(\d+)$"
    held_no = all_taken.select(
        F.regexp_extract("doc_id", numbered, 1).alias("base"),
        F.regexp_extract("doc_id", numbered, 2).try_cast("long").alias("u"),
    ).filter("u >= 2 and base != ''")
    held_no = rank_within(held_no.join(rest.select("base").distinct(), "base", "left_semi"), ["base"], ["u"], "j")
    wanted = rest.select("base", F.col("m").alias("v"), F.lit(0).alias("tag"), "path")
    holding = held_no.select("base", (F.col("u") - 1 - F.col("j")).alias("v"), F.lit(1).alias("tag"), F.lit(None).cast("string").alias("path"))
    # held numbers with fewer than m free numbers below them stand before the m-th wanted one
    merged = rank_within(wanted.unionByName(holding), ["base"], ["v", "tag", "path"], "place")
    third = merged.filter("tag = 0").select("path", F.concat("base", F.lit("-"), (F.col("place") + 1).cast("string")).alias("doc_id"))
    return first.unionByName(second).unionByName(third)
