"""Read-only SQL, saved results with their sources, exports, chart data, source lists, the publish gate."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, NumericType, TimestampNTZType, TimestampType

from attestra.functions.anchors import human_location, parse_ref
from attestra.scale import numbered

# fixed values
MAX_SAVED_ROWS = 1000
SHOWN_ROWS = 25
WRITE_VERBS = (
    r"^\s*(insert|update|delete|create|drop|alter|attach|copy|export|install|load|pragma|set|call|merge|truncate|refresh|"
    r"cache|uncache|clear|analyze|add|reset|use|msck|repair)\b"
)
FILE_CALL = re.compile(r"\b(?:read_files|read_csv|read_parquet|read_json|reflect|java_method|try_reflect)\s*\(", re.IGNORECASE)


class SqlRefused(ValueError):
    """The statement is not a plain read of the named tables."""


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A read query over named tables only: no writes, no files, no session changes, no other views.

    The parsed statement decides: it may hold no command and no statement text, and every relation it reads must be in
    ``tables`` or a common table expression of its own. The names are taken off the session again.
    """
    if re.match(WRITE_VERBS, sql, re.IGNORECASE):
        raise SqlRefused("This statement would change something; only SELECT, WITH and DESCRIBE are run.")
    text = sql.rstrip().rstrip(";")
    summary = re.match(r"^\s*summarize\s+(\w+)\s*$", text, re.IGNORECASE)
    if summary and summary.group(1) in tables:
        return summarize(tables[summary.group(1)])
    _refuse_all_but_reads(spark, text, tables)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text)
    except Exception as exc:
        first = str(exc).split("\n", 1)[0]
        hint = " Look up exact table and column names in the catalog." if "NOT_FOUND" in first or "UNRESOLVED" in first else ""
        raise SqlRefused(first + hint) from None
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)


RELATION = re.compile(r"'?UnresolvedRelation \[([^\]]*)\]")
NAMED_HERE = re.compile(r"(?:CTE|UnresolvedWith) \[([^\]]*)\]")
NO_READ = re.compile(r"ExecuteImmediate|InsertInto|CompoundBody|SingleStatement|UnresolvedTableValuedFunction \[(?!range\b|explode|posexplode|inline|stack\b|json_tuple)", re.I)


def _refuse_all_but_reads(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> None:
    jvm = spark._jvm
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as exc:
        raise SqlRefused(str(exc).strip().split("\n", 1)[0]) from None
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    command = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command", True, loader)
    shown = plan.treeString()
    described = re.match(r"^\s*desc(?:ribe)?\s+(?:table\s+)?`?(\w+)`?\s*$", sql, re.IGNORECASE)
    if described and described.group(1) in tables:
        return
    if command.isInstance(plan) or NO_READ.search(shown) or FILE_CALL.search(re.sub(r"'(?:[^']|'')*'", "''", sql)):
        raise SqlRefused("Only a read of the named tables is run: SELECT, WITH or DESCRIBE of one of them.")
    own = {n.strip().lower() for names in NAMED_HERE.findall(shown) for n in names.split(",")}
    known = {n.lower() for n in tables}
    for name in {r.split(", ,")[0].strip().lower() for r in RELATION.findall(shown)}:
        if name not in known and (name not in own or spark.catalog.tableExists(name)):
            raise SqlRefused(f"'{name}' is not among the tables of this query: {', '.join(sorted(known))}. Look up names in the catalog.")


def used_tables(sql: str, names: Iterable[str]) -> list[str]:
    return sorted(n for n in names if re.search(rf'(?<![\w"`]){re.escape(n)}(?![\w"`])|["`]{re.escape(n)}["`]', sql))


def what_if(base: DataFrame, key: str, option: str, replaces: str, pick: str, extra: list[str] | None = None) -> DataFrame:
    """Rows of the baseline with those of a chosen option in place of the ones they name in ``replaces``."""
    chosen = base.filter((F.col(option) == pick) | F.col(key).isin(extra or []))
    gone = chosen.filter(F.col(replaces).isNotNull()).select(F.explode(F.split(replaces, ";")).alias("_k"))
    gone = gone.select(F.trim("_k").alias(key)).distinct()
    return base.filter(F.col(option) == "baseline").join(gone, key, "left_anti").unionByName(chosen)


def summarize(df: DataFrame) -> DataFrame:
    """One row per column: min, max, distinct, mean, deviation, quartiles, count, share of nulls. One pass."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = {n for n, t in kinds.items() if isinstance(t, NumericType)}
    aggs: list[Column] = [F.count("*").alias("_n")]
    for i, n in enumerate(kinds):
        c = F.col(n)
        num = c.cast("double") if n in numeric else F.lit(None).cast("double")
        aggs += [
            F.min(c).cast("string").alias(f"min{i}"),
            F.max(c).cast("string").alias(f"max{i}"),
            F.approx_count_distinct(c).alias(f"dis{i}"),
            F.avg(num).alias(f"avg{i}"),
            F.stddev(num).alias(f"std{i}"),
            F.percentile_approx(num, [0.25, 0.5, 0.75], 10000).alias(f"per{i}"),
            F.count(c).alias(f"cnt{i}"),
        ]
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.lit(kinds[n].simpleString()).alias("column_type"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
            F.col(f"dis{i}").alias("approx_unique"),
            F.col(f"avg{i}").alias("avg"),
            F.col(f"std{i}").alias("std"),
            F.get(f"per{i}", F.lit(0)).alias("q25"),
            F.get(f"per{i}", F.lit(1)).alias("q50"),
            F.get(f"per{i}", F.lit(2)).alias("q75"),
            F.col("_n").alias("count"),
            F.round(100.0 * (F.col("_n") - F.col(f"cnt{i}")) / F.nullif(F.col("_n"), F.lit(0)), 2).alias("null_percentage"),
        )
        for i, n in enumerate(kinds)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def probe(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null) of every column in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"), F.col(c).alias("n_null")) for c in df.columns]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def row_cap(df: DataFrame, order: list, max_rows: int = MAX_SAVED_ROWS) -> DataFrame:
    """At most ``max_rows`` rows with ``more``: whether there are further ones. One row too many is read to know."""
    top = df.orderBy(*order).limit(max_rows + 1)
    numbered = top.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    seen = numbered.withColumn("more", F.max("_rn").over(Window.partitionBy(F.lit(1))) > max_rows)
    return seen.filter(F.col("_rn") <= max_rows).drop("_rn")


def json_safe(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, decimals as doubles, anything that is not plain as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif not isinstance(f.dataType, (NumericType, BooleanType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def result_rows(df: DataFrame, order: list, max_rows: int | None = None) -> DataFrame:
    """(row_no, row_json) of a result's rows in order: all of them, or the first ``max_rows``.

    Rows are numbered by their place in a distributed sort, so a result of any size is saved by many tasks.
    """
    safe_names = df.columns
    kept = df if max_rows is None else row_cap(df, order, max_rows).drop("more")
    safe = json_safe(numbered(kept, order, "_no"))
    return safe.select((F.col("_no") + 1).alias("row_no"), F.to_json(F.struct(*safe_names), {"ignoreNullFields": "false"}).alias("row_json"))


def save_result(spark: SparkSession, df: DataFrame, order: list, sql: str, tables: dict[str, str], folder: str, max_rows: int | None = None) -> int:
    """Append a result under ``folder`` and return its number. ``tables`` maps table name to source file.

    Every number has a folder of rows of its own, which a second writer cannot take as well: it goes on to the next
    number. The registry row is written last, so a number seen there has all its rows. ``row_count`` counts the
    result itself; ``more`` says whether ``max_rows`` left some of them out.
    """
    registry = f"{folder}/registry"
    try:
        last = spark.read.parquet(registry).agg(F.max("result_id")).first()[0] or 0
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        last = 0
    number = last + 1
    used = used_tables(sql, tables)
    rows = result_rows(df, order, max_rows)
    while True:
        try:
            rows.write.mode("errorifexists").parquet(f"{folder}/rows/result_id={number}")
            break
        except AnalysisException as exc:
            if "PATH_ALREADY_EXISTS" not in str(exc):
                raise
            number += 1
    saved = spark.read.parquet(f"{folder}/rows/result_id={number}").count()
    total = saved if max_rows is None else df.count()
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    entry = spark.range(1).select(
        F.lit(number).alias("result_id"),
        F.current_timestamp().alias("created"),
        F.lit(sql.strip()).alias("sql"),
        strings(used).alias("tables"),
        strings(sorted({tables[t] for t in used})).alias("source_files"),
        strings(df.columns).alias("columns"),
        strings([f.dataType.typeName() if isinstance(f.dataType, NumericType) else "text" for f in df.schema.fields]).alias("types"),
        F.lit(total).cast("long").alias("row_count"),
        F.lit(total > saved).alias("more"),
    )
    entry.write.mode("append").parquet(registry)
    return number


def read_result(spark: SparkSession, folder: str, number: int, shown: int | None = SHOWN_ROWS) -> tuple[DataFrame, DataFrame]:
    """(registry row, first rows) of a saved result; all rows where ``shown`` is None."""
    head = spark.read.parquet(f"{folder}/registry").filter(F.col("result_id") == number)
    rows = spark.read.parquet(f"{folder}/rows").filter(F.col("result_id") == number)
    return head, rows if shown is None else rows.filter(F.col("row_no") <= shown)


def export_results(spark: SparkSession, folder: str, numbers: list[int], out: str) -> DataFrame:
    """Write every result typed again (ISO text that is a date throughout becomes a date) and return the provenance.

    The registry tells names and kinds of the columns; one job over all asked results finds the columns of dates. Only
    these facts, a row for each column, come to the driver; each result is then one write of its own rows.
    """
    registry = spark.read.parquet(f"{folder}/registry").filter(F.col("result_id").isin(numbers))
    rows = spark.read.parquet(f"{folder}/rows").filter(F.col("result_id").isin(numbers))
    known = {r["result_id"]: list(zip(r["columns"], r["types"])) for r in registry.select("result_id", "columns", "types").collect()}
    cells = F.from_json("row_json", "map<string,string>")
    values = rows.select("result_id", F.explode(cells).alias("k", "x")).filter("x is not null")
    iso = F.col("x").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("x").try_cast("date").isNotNull()
    dates = {(r["result_id"], r["k"]) for r in values.groupBy("result_id", "k").agg(F.bool_and(iso).alias("d")).filter("d").collect()}
    for number, columns in known.items():
        kinds = {c: "double" if t != "text" else "date" if (number, c) in dates else "string" for c, t in columns}
        wide = rows.filter(F.col("result_id") == number).select("row_no", cells.alias("m")).sort("row_no")
        wide.select(*(F.col("m").getItem(c).cast(kinds[c]).alias(c) for c, _ in columns)).write.mode("overwrite").parquet(f"{out}/result_{number}")
    return registry.select(
        F.concat(F.lit("calc:"), F.col("result_id").cast("string")).alias("result"),
        "created", "row_count", F.array_join("source_files", ", ").alias("source_files"), "sql",
    )


def chart_data(df: DataFrame, x: str | None = None, ys: list[str] | None = None) -> DataFrame:
    """(x, series, value) of a chart: the first column against all numeric ones unless named; gaps are 0."""
    x = x or df.columns[0]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != x]
    ys = ys or numeric
    for c in [x, *ys]:
        if c not in df.columns:
            raise ValueError(f"chart column '{c}' not in {df.columns}")
    wide = df.select(F.col(x).cast("string").alias("x"), *[F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias(y) for y in ys])
    return wide.unpivot(["x"], ys, "series", "value")


def number_sources(citations: DataFrame, docs: DataFrame, results: DataFrame) -> DataFrame:
    """(draft_id, number, ref, entry): refs of a draft numbered by first appearance and described.

    ``citations`` holds (draft_id, pos, ref), ``docs`` (doc_id, title, path, doc_type), ``results``
    (result_id, sql, source_files).
    """
    first = citations.groupBy("draft_id", "ref").agg(F.min("pos").alias("pos"))
    refs = first.select("ref").distinct().withColumn("p", parse_ref(F.col("ref")))
    refs = refs.withColumn("result_id", F.regexp_extract("ref", r"^calc:(\d+)$", 1).try_cast("int"))
    described = refs.select("ref", "result_id", F.col("p.doc").alias("doc_id"), F.col("p.anchor").alias("anchor"))
    described = described.join(docs.select("doc_id", "title", "path", "doc_type"), "doc_id", "left").join(
        results.select("result_id", "sql", "source_files"), "result_id", "left"
    )
    place = human_location(F.col("doc_type"), F.col("anchor"))
    files = F.coalesce(F.nullif(F.array_join("source_files", ", "), F.lit("")), F.lit("workspace tables"))
    flat = F.trim(F.regexp_replace("sql", r"\s+", " "))
    calc = F.col("ref").startswith("calc:")
    entry = (
        F.when(calc & F.col("sql").isNull(), F.concat(F.lit("Calculation "), "ref", F.lit(" (missing)")))
        .when(calc, F.concat(F.lit("Calculation "), "ref", F.lit(" over "), files, F.lit(". SQL: "), flat))
        .when(F.col("path").isNull(), F.concat("ref", F.lit(" (unresolved)")))
        .otherwise(F.concat("title", F.lit(" — "), "path", F.when(F.col("anchor").isNull(), "").otherwise(F.concat(F.lit(", "), place))))
    )
    named = first.join(described.select("ref", entry.alias("entry")), "ref")
    n = F.row_number().over(Window.partitionBy("draft_id").orderBy("pos", "ref"))
    return named.select("draft_id", n.alias("number"), "ref", "entry")


def gate(drafts: DataFrame, reports: DataFrame, force: bool = False) -> DataFrame:
    """Drafts that may be published: those whose check did not fail; forced ones carry a stamp."""
    # a report for each draft: neither side is one to be sent to every task
    checked = drafts.join(reports.select("draft_id", "status").hint("merge"), "draft_id", "left")
    failed = F.coalesce(F.col("status"), F.lit("FAIL")) == "FAIL"
    stamped = checked.withColumn("stamp", F.when(failed, "UNVERIFIED"))
    return stamped if force else stamped.filter(~failed)


def split_sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``section_no`` from 1: explicit rules part sections if there are any, else headings of level 1 and 2 do.

    Rules themselves are dropped and empty sections are not counted. The running number is a window
    over one document, which comes from one row.
    """
    w = Window.partitionBy(key)
    run = w.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rule = F.col("kind") == "rule"
    flagged = blocks.withColumn("_explicit", F.max(F.when(rule, 1).otherwise(0)).over(w) == 1)
    head = (F.col("kind") == "heading") & (F.col("level") <= 2)
    cut = F.when(F.col("_explicit"), rule).otherwise(head)
    raw = flagged.withColumn("_part", F.sum(F.when(cut, 1).otherwise(0)).over(run)).filter(~rule)
    number = F.dense_rank().over(w.orderBy("_part"))
    return raw.withColumn("section_no", number).drop("_explicit", "_part")
