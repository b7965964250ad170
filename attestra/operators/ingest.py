"""Keeping a corpus current: snapshot differences, content confirmation, incremental replacement, failures, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
MTIME_TOLERANCE = 1e-6
SHOWN = 30


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """(key, status): new, modified, deleted or unchanged, by size and time of change (in seconds)."""
    o = old.select(key, F.col("size").alias("_os"), F.col("mtime").alias("_om"), F.lit(True).alias("_o"))
    n = new.select(key, F.col("size").alias("_ns"), F.col("mtime").alias("_nm"), F.lit(True).alias("_n"))
    moved = ~F.col("_os").eqNullSafe(F.col("_ns")) | (F.abs(F.col("_nm") - F.col("_om")) > MTIME_TOLERANCE)
    status = (
        F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(moved, "modified").otherwise("unchanged")
    )
    return o.join(n, key, "full").select(key, status.alias("status"))


def hash_confirm(diff: DataFrame, old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Modified files whose content digest is the same were only touched. One shuffle brings a file's three rows together."""
    none = F.lit(None).cast("string")
    rows = diff.select(key, "status", none.alias("_oh"), none.alias("_nh"))
    rows = rows.unionByName(old.select(key, none.alias("status"), F.col("sha256").cast("string").alias("_oh"), none.alias("_nh")))
    rows = rows.unionByName(new.select(key, none.alias("status"), none.alias("_oh"), F.col("sha256").cast("string").alias("_nh")))
    both = rows.groupBy(key).agg(*(F.max(c).alias(c) for c in ("status", "_oh", "_nh"))).filter("status is not null")
    same = (F.col("status") == "modified") & (F.col("_oh") == F.col("_nh"))
    return both.select(key, F.when(F.coalesce(same, F.lit(False)), "touched").otherwise(F.col("status")).alias("status"))


def apply_changes(state: DataFrame, fresh: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of documents that did not change, and the fresh rows of those that did."""
    gone = removed.select(key).unionByName(fresh.select(key)).distinct()
    return state.join(gone, key, "left_anti").unionByName(fresh)


def with_errors(df: DataFrame, value: Column, name: str, message: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose value could be read, and the rest with the reason; one bad row stops nothing."""
    tried = df.withColumn(name, value)
    return tried.filter(F.col(name).isNotNull()), tried.filter(F.col(name).isNull()).drop(name).withColumn("error", F.lit(message))


def ingest_report(diff: DataFrame, key: str = "path", shown: int = SHOWN) -> DataFrame:
    """(status, n, listed): counts and the first names of each status. Only the names shown are gathered."""
    counts = diff.groupBy("status").agg(F.count("*").alias("n"))
    w = Window.partitionBy("status").orderBy(key)
    first = diff.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= shown)
    names = first.groupBy("status").agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ", ").alias("listed"))
    out = counts.join(names, "status")
    more = F.when(F.col("n") > shown, " …").otherwise("")
    return out.select("status", "n", F.concat("listed", more).alias("listed"))
