"""The ingest job: files to documents, blocks, chunks and typed tables that change together or not at all.

A corpus is a folder. Every ingest writes the rows of new and changed documents of all tables under its version number, and
commits with one row of the manifest, written last; a version that is not in the manifest is never read, so a failure between two
writes leaves the version before as it was. Documents that did not change are not written again: the table of documents says
in which version the rows of a document are. ``compact`` writes everything into one version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.text import sql_ident, strip
from attestra.operators.chunks import CHUNK_CHARS, assign_doc_ids, make_chunks
from attestra.operators.ingest import hash_confirm, ingest_report, snapshot_diff
from attestra.operators.packing import TILE
from attestra.operators.typed import TABLE, coerce_cell, convert, infer_types, table_names, unique_names
from attestra.session import durable, passing
from attestra.sources.blocks import KEPT_META, front_matter, pipe_table_cells, segment_text
from attestra.sources.delimited import delimited_blocks, read_delimited
from attestra.sources.html import html_blocks, html_sections, html_table_cells, html_title

DOCS = "doc_id string, path string, doc_type string, title string, meta map<string,string>, sha256 string, size long, mtime double, live boolean, content long"
BLOCKS = "doc_id string, seq int, anchor string, kind string, section string, text string, level int"
CHUNKS = "doc_id string, first_seq long, last_seq long, anchor string, section string, text string"
COLUMNS = "doc_id string, sheet string, table_name string, c int, name string, orig string, type string, n long, notes string"
CELLS = "doc_id string, sheet string, r long, c int, v string"
TABLES = {"docs": DOCS, "blocks": BLOCKS, "chunks": CHUNKS, "columns": COLUMNS, "cells": CELLS}
MANIFEST = "version long, base boolean"
TYPES = {"md": "md", "markdown": "md", "txt": "txt", "html": "html", "htm": "html", "csv": "csv", "tsv": "csv"}
KINDS = ["BIGINT", "DOUBLE", "BOOLEAN", "DATE", "TIMESTAMP", "VARCHAR"]


def doc_type(path: Column) -> Column:
    """By the end of the name; null where the corpus has no reader for it."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), ending)


class Corpus:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str, version: int) -> str:
        return f"{self.folder}/{name}/version={version}"

    def _manifest(self) -> list[tuple[int, bool]]:
        """Committed versions, oldest first; one row each."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").orderBy("version").collect()
        return [(r.version, r.base) for r in rows]

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max((v for v, _ in self._manifest()), default=0)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table (``docs, blocks, chunks, columns, cells``) as of a committed version, by default the newest."""
        known = self._manifest()
        if version is not None and version not in [v for v, _ in known]:
            raise ValueError(f"the corpus has no version {version}")
        upto = [(v, base) for v, base in known if version is None or v <= version]
        start = max((v for v, base in upto if base), default=0)
        parts = [v for v, _ in upto if v >= start]
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])

        def rows(table: str) -> DataFrame:
            paths = [self._path(table, v) for v in parts]
            return self.spark.read.schema(f"{TABLES[table]}, version long").option("basePath", f"{self.folder}/{table}").parquet(*paths)

        docs = rows("docs")
        newest = docs.groupBy("doc_id").agg(F.max("version").alias("version"))
        docs = docs.join(newest, ["doc_id", "version"]).filter("live").drop("version")
        if name == "docs":
            return docs.select([f.split()[0] for f in DOCS.split(", ")])
        held = docs.select("doc_id", F.col("content").alias("version"))
        return rows(name).join(held, ["doc_id", "version"], "left_semi").drop("version")

    def ingest(self, files: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
        """Bring the corpus to what ``files`` (path, size, mtime in seconds, sha256, text) are, and report by status.

        Files that have no reader or no text are reported as failed; the document they had stays as it was.
        """
        with passing(self.spark):
            return ingest_report(self._ingest(files, chunk_chars))

    def _ingest(self, files: DataFrame, chunk_chars: int) -> DataFrame:
        """What became of every file (path, status). Tables go as soon as nothing reads them any more."""
        old, number = self.read("docs"), self.version() + 1
        old = durable(old)
        # sizes and digests come from the texts: they are worked out once
        bad = doc_type(F.col("path")).isNull() | F.col("text").isNull()
        listed = files.select("path", F.col("size").cast("long").alias("size"), F.col("mtime").cast("double").alias("mtime"), "sha256", bad.alias("_bad"))
        listed = durable(listed)
        bad, listed = listed.filter("_bad").select("path", "_bad"), listed.drop("_bad")
        before = old.select("path", "size", "mtime", "sha256")
        diff = hash_confirm(snapshot_diff(before, listed), before, listed)
        status = F.when(F.col("_bad") & F.col("status").isin("new", "modified"), "failed").otherwise(F.col("status"))
        diff = durable(diff.join(bad, "path", "left").select("path", status.alias("status")), kept=True)
        touched = listed.join(diff.filter("status = 'touched'"), "path").join(old.drop("size", "mtime", "sha256"), "path")
        gone = old.join(diff.filter("status = 'deleted'").select("path"), "path", "left_semi").withColumn("live", F.lit(False))
        # the texts as they came and as they were read are gone before chunks are made
        with passing(self.spark):
            ids = old.select("path", "doc_id")
            added = assign_doc_ids(diff.filter("status = 'new'"), ids)
            fresh = files.join(diff.filter("status in ('new', 'modified')"), "path").join(ids.unionByName(added), "path")
            fresh = durable(fresh.select("doc_id", "path", doc_type(F.col("path")).alias("doc_type"), "text", F.col("size").cast("long").alias("size"), F.col("mtime").cast("double").alias("mtime"), "sha256"))
            parts = {kind: fresh.filter(F.col("doc_type") == kind) for (kind,) in fresh.select("doc_type").distinct().collect()}  # the kinds of TYPES
            # what both blocks and cells are made of is read once
            read = {kind: durable(READERS[kind](part)) if kind in ("md", "csv") else READERS[kind](part) for kind, part in parts.items()}
            empty = lambda name: self.spark.createDataFrame([], TABLES[name])
            # blocks stay where they are written: nothing reads a version before it is committed
            self._write(number, {"blocks": reduce(DataFrame.unionByName, [_blocks(kind, df) for kind, df in read.items()], empty("blocks"))})
            blocks = self.spark.read.schema(BLOCKS).parquet(self._path("blocks", number))
            none = self.spark.createDataFrame([], f"{CELLS}, kind string")
            cells = durable(reduce(DataFrame.unionByName, [_cells(kind, df, parts[kind]) for kind, df in read.items() if kind != "txt"], none), kept=True)
            docs = _documents(fresh, blocks).withColumns({"live": F.lit(True), "content": F.lit(number).cast("long")})
            self._write(number, {"docs": docs.unionByName(touched.drop("status")).unionByName(gone)})
            named = durable(fresh.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1"), kept=True)
        columns = durable(_columns(cells))
        fit = cells.filter("r > 1").join(columns.select(*TABLE, "c", "type"), [*TABLE, "c"])
        value = F.lit(None).cast("string")
        for kind in KINDS:
            value = F.when(F.col("type") == kind, convert(F.col("v"), F.col("kind"), kind)).otherwise(value)
        self._write(number, {"columns": columns, "cells": fit.select(*TABLE, "r", "c", value.alias("v"))})
        self._write(number, {"chunks": make_chunks(_sized(blocks, named), chunk_chars, "_n")})
        self._commit(number, False)
        return diff

    def compact(self) -> None:
        """Write the newest version as one that needs none before it."""
        number = self.version() + 1
        tables = {name: self.read(name) for name in TABLES}
        tables["docs"] = tables["docs"].withColumn("content", F.lit(number).cast("long"))
        self._write(number, tables)
        self._commit(number, True)

    def _write(self, number: int, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            fields = [f.split(" ") for f in TABLES[name].split(", ")]
            out = df.select(*(F.col(n).cast(t).alias(n) for n, t in fields))
            out.write.mode("overwrite").option("compression", "zstd").parquet(self._path(name, number))

    def _commit(self, number: int, base: bool) -> None:
        self.spark.createDataFrame([(number, base)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")


def _sized(blocks: DataFrame, twice: DataFrame) -> DataFrame:
    """Blocks with ``_n``, above every seq of a document that is cut in tiles, 0 for others. Only the list of these documents is joined. A document
    that came ``n`` times (``twice``) has each block as often."""
    long = durable(blocks.groupBy("doc_id").agg((F.max("seq") + 1).alias("_n")).filter(F.col("_n") > TILE))
    if not twice.isEmpty():
        blocks = blocks.join(twice, "doc_id", "left").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1))))).drop("n", "_i")
    sized = blocks.filter("doc_id is not null")
    if long.isEmpty():
        return sized.withColumn("_n", F.lit(0))
    return sized.join(long, "doc_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))


def _documents(fresh: DataFrame, blocks: DataFrame) -> DataFrame:
    """Title: that of the front matter or page, else the first heading, else the name of the file. Of the front matter the
    keys of ``KEPT_META`` are kept."""
    heads = blocks.filter("kind = 'heading'").groupBy("doc_id").agg(F.min_by("text", "seq").alias("head"))
    meta = F.when(F.col("doc_type") == "md", F.map_filter(front_matter(F.col("text"))["meta"], lambda k, v: k.isin(KEPT_META))).otherwise(F.create_map().cast("map<string,string>"))
    named = F.when(F.col("doc_type") == "html", html_title(F.col("text")))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    told = lambda c: F.when(strip(c) != "", c)
    with_meta = fresh.withColumns({"meta": meta, "named": named}).join(heads, "doc_id", "left")
    title = F.coalesce(told(F.try_element_at("meta", F.lit("title"))), told(F.col("named")), told(F.col("head")), stem)
    return with_meta.select("doc_id", "path", "doc_type", title.alias("title"), "meta", "sha256", "size", "mtime")


READERS = {
    "md": segment_text,
    "txt": lambda files: segment_text(files, markdown=False),
    "html": lambda files: html_sections(html_blocks(files, "doc_id", "text")).withColumn("anchor", F.concat(F.lit("b"), (F.col("seq") + 1).cast("string"))),
    "csv": read_delimited,
}


def _blocks(kind: str, read: DataFrame) -> DataFrame:
    if kind == "csv":
        read = delimited_blocks(read).withColumn("level", F.lit(None).cast("int"))
    return read.select(*(F.col(n).cast(t).alias(n) for n, t in (f.split() for f in BLOCKS.split(", "))))


def _cells(kind: str, read: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, sheet, r, c, v, kind): a delimited file, or the tables of Markdown and pages; row 1 is the header."""
    if kind == "csv":
        cells = read.select("doc_id", F.lit("rows").alias("sheet"), "r", F.posexplode("fitted").alias("c", "v")).withColumn("c", F.col("c") + 1)
    elif kind == "md":
        cells = pipe_table_cells(read)
    else:
        cells = html_table_cells(files, "doc_id", "text").withColumn("sheet", F.concat(F.lit("Table "), F.col("t").cast("string")))
    cells = cells.select(*TABLE, F.col("r").cast("long").alias("r"), "c", coerce_cell(F.col("v")).alias("x"))
    return cells.select(*TABLE, "r", "c", "x.v", "x.kind")


def _columns(cells: DataFrame) -> DataFrame:
    """Columns of the tables that have a row besides the header, with their names and types."""
    heads = cells.filter("r = 1").select(*TABLE, "c", F.coalesce("v", F.concat(F.lit("col"), F.col("c").cast("string"))).alias("orig"))
    types = infer_types(cells.filter("r > 1"))
    named = unique_names(heads.withColumn("ident", sql_ident(F.col("orig"))), TABLE, "c").select(*TABLE, "c", F.col("unique_name").alias("name"))
    tables = types.select(*TABLE).distinct().withColumns({"source_name": F.col("sheet"), "table_no": F.col("sheet")})
    tables = table_names(tables).select(*TABLE, "table_name")
    return types.join(heads, [*TABLE, "c"]).join(named, [*TABLE, "c"]).join(tables, TABLE).select(*TABLE, "table_name", "c", "name", "orig", "type", "n", "notes")
