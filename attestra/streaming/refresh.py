"""New, changed and removed files are taken in as they are seen: the streaming form of the refresh.

``stream_ingest`` takes in new files alone: a file source reads no path twice and tells nothing of files that go. So
listings of the source are recorded, and ``stream_refresh`` streams these. Paths are dealt to ``BUCKETS`` keys; the state of a
key holds its paths with their size, time and the newest listing each is in. A listing that has come in whole makes an event
of every path that is new, changed or gone since, and the contents of new and changed files are read in the same batch.

Both append their rows under the batch number, replacing what an earlier attempt of the same batch left, and readers take the
newest version of each path; so a lost executor or a repeated batch changes nothing. The state takes a path and a few numbers
for every file that is there, in the checkpoint folder (RocksDB); removed paths leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from attestra.functions.text import decode_text
from attestra.session import ships_with_job

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
BUCKETS = 64
LISTING = "listing long, bucket int, path string, size long, mtime timestamp, expected long"
EVENT = "path string, listing long, status string, mtime timestamp"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

ships_with_job(__name__)


def _files(reader, source: str, glob: str) -> DataFrame:
    return reader.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(source)


def _read(files: DataFrame) -> DataFrame:
    named = [F.col("modificationTime").alias("mtime"), F.col("length").alias("size")]
    return files.select("path", *named, F.sha2("content", 256).alias("sha256"), decode_text(F.col("content")).alias("text"))


def _append(batch: DataFrame, table: str, number: int) -> None:
    numbered = batch.withColumn("batch", F.lit(number))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)


def stream_ingest(spark: SparkSession, source: str, table: str, checkpoint: str, glob: str = "*") -> StreamingQuery:
    """Read new files under ``source`` as they come and write documents to ``table``; stops when caught up."""
    docs = _read(_files(spark.readStream.schema(FILE_SCHEMA), source, glob))
    return docs.writeStream.foreachBatch(lambda batch, number: _append(batch, table, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_listing(spark: SparkSession, source: str, listings: str, number: int, glob: str = "*") -> None:
    """Write which files are under ``source`` now as listing ``number``; numbers must grow. Contents are not read.

    Every key gets a row of its own, so that it learns of a listing that has none of its paths, and every row says how many
    the key will get, so that a listing may arrive in pieces.
    """
    files = _files(spark.read, source, glob)
    rows = files.select(F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    rows = rows.unionByName(spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")), allowMissingColumns=True)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("expected"))
    rows.join(sizes, "bucket").select(F.lit(number).cast("long").alias("listing"), "bucket", "path", "size", "mtime", "expected").write.mode("append").parquet(listings)


class Listed(StatefulProcessor):
    """Of one key: the paths of the last whole listing, the paths of newer listings that are not whole, and their counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        seen = T.StructType([T.StructField("size", T.LongType()), T.StructField("mtime", T.TimestampType())])
        path = T.StructField("path", T.StringType())
        listing = T.StructField("listing", T.LongType())
        number = T.StructType([T.StructField("n", T.LongType())])
        self.paths = handle.getMapState("paths", T.StructType([path]), seen)
        self.coming = handle.getMapState("coming", T.StructType([listing, path]), seen)
        self.counts = handle.getMapState("counts", T.StructType([listing]), number)
        self.last = handle.getValueState("last", number)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        counts, expected = {}, {}
        for part in rows:
            for listing, path, size, mtime, n in part[["listing", "path", "size", "mtime", "expected"]].itertuples(index=False):
                if listing <= last:  # a newer listing has made it void
                    continue
                expected[listing] = n
                counts[listing] = counts.get(listing, 0) + 1
                if path is not None:
                    self.coming.updateValue((int(listing), path), (int(size), mtime.to_pydatetime()))
        for listing, n in counts.items():
            counts[listing] = n + (self.counts.getValue((int(listing),))[0] if self.counts.containsKey((int(listing),)) else 0)
            self.counts.updateValue((int(listing),), (int(counts[listing]),))
        whole = [listing for listing, n in counts.items() if n >= expected[listing]]
        if whole:
            yield from self._told(max(whole))  # of several whole listings the newest decides

    def _told(self, newest: int) -> Iterator[pd.DataFrame]:
        events, here = [], set()
        for (listing, path), (size, mtime) in list(self.coming.iterator()):
            if listing == newest:
                here.add(path)
                known = tuple(self.paths.getValue((path,))) if self.paths.containsKey((path,)) else None
                if known != (size, mtime):
                    events.append((path, newest, "new" if known is None else "modified", mtime))
                    self.paths.updateValue((path,), (size, mtime))
            if listing <= newest:
                self.coming.removeKey((listing, path))
        for (path,) in list(self.paths.keys()):
            if path not in here:
                self.paths.removeKey((path,))
                events.append((path, newest, "removed", None))
        for (listing,) in list(self.counts.keys()):
            if listing <= newest:
                self.counts.removeKey((listing,))
        self.last.update((int(newest),))
        if events:
            yield pd.DataFrame(events, columns=["path", "listing", "status", "mtime"]).astype({"mtime": "datetime64[ns]"})

    def close(self) -> None:
        pass


def stream_refresh(spark: SparkSession, listings: str, events: str, checkpoint: str, source: str | None = None, table: str | None = None, glob: str = "*") -> StreamingQuery:
    """Write the changes between recorded listings to ``events`` and, with ``source`` and ``table``, the documents of new and
    changed files to ``table``; stops when caught up. Only files of the time of the oldest change or later are read."""
    spark.conf.set(*STATE_STORE)
    rows = spark.readStream.schema(LISTING).parquet(listings)
    told = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Listed(), outputStructType=EVENT, outputMode="Append", timeMode="None")

    def write(batch: DataFrame, number: int) -> None:
        _append(batch, events, number)
        if table is None:
            return
        changed = spark.read.schema(f"{EVENT}, batch int").parquet(events).filter((F.col("batch") == number) & (F.col("status") != "removed"))
        oldest = changed.agg(F.min("mtime")).first()[0]
        if oldest is not None:
            files = _files(spark.read, source, glob).filter(F.col("modificationTime") >= F.lit(oldest))
            _append(_read(files).join(changed.select("path"), "path", "left_semi"), table, number)

    return told.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_docs(spark: SparkSession, table: str, events: str | None = None) -> DataFrame:
    """Newest version of each path that is not removed. A path that no listing has told of is there."""
    rows = spark.read.parquet(table)
    newest = Window.partitionBy("path").orderBy(F.col("batch").desc(), F.col("mtime").desc())
    docs = rows.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")
    if events is None:
        return docs
    told = spark.read.schema(EVENT).parquet(events)
    gone = told.groupBy("path").agg(F.max_by("status", "listing").alias("_last")).filter("_last = 'removed'")
    return docs.join(gone, "path", "left_anti")
