"""Vector search over an embeddings column; the model that makes vectors is outside this library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestra.session import durable, ships_with_job

ships_with_job(__name__)

EPS = 1e-9
MAX_EMBED_CHARS = 2000
QUERY_VALUES = 1 << 20  # numbers of query vectors that travel with one pass over the corpus: 8 MB
SIM_DIGITS = 9  # similarities are compared to this many places, so that sums in any order tie alike


def l2_normalize(c: Column) -> Column:
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x / F.greatest(norm, F.lit(EPS)))


def nearest(vectors: DataFrame, queries: list[list[float]], k: int, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, sim) of the k vectors closest to any of the query vectors, by cosine.

    The query vectors are arguments of one search, a handful of rows that travel with the task. Every
    Arrow batch is one matrix product and hands on only its own k best, so what reaches the final
    limited sort is k rows per batch.
    """
    q = np.asarray(queries, dtype=np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), EPS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if batch.num_rows == 0:
                continue
            mat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            mat /= np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), EPS)
            sims = (mat @ q.T).max(axis=1)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            best = np.lexsort((ids, -sims))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[best]), pa.array(sims[best])], names=[id, "sim"])

    typ = vectors.schema[id].dataType.simpleString()
    rows = vectors.filter(F.col(vec).isNotNull()).select(id, vec)
    return rows.mapInArrow(score, f"{id} {typ}, sim double").orderBy(F.col("sim").desc(), id).limit(k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(search_id, rank, id, sim) of the k vectors closest to each search, by cosine; ties go to the smaller id.

    ``queries`` has a row (search_id, vector) per phrasing; a search counts the best of its phrasings. Filter
    ``vectors`` to the documents allowed before: only those are scored. Missing vectors and vectors of another
    length are of another model and are left out on both sides.

    Searches travel with the tasks in blocks of ``QUERY_VALUES`` numbers, each block one pass over the vectors,
    written when it is done. A task keeps the k best of every search of the block while it reads, so what is
    shuffled is k rows per search and task, however many vectors there are.
    """
    typ = vectors.schema[id].dataType.simpleString()
    key = queries.schema["search_id"].dataType.simpleString()
    asked = queries.select("search_id", F.col(vec).cast("array<double>").alias("q")).filter("q is not null and size(q) > 0")
    asked = durable(asked)
    dim = asked.agg(F.max(F.size("q"))).first()[0]
    schema = f"search_id {key}, {id} {typ}, sim double"
    if dim is None:
        return vectors.sparkSession.createDataFrame([], f"search_id {key}, rank int, {id} {typ}, sim double")
    rows = vectors.filter(F.size(vec) == dim).select(id, F.col(vec).cast("array<double>").alias("v"))
    best = Window.partitionBy("search_id").orderBy(F.col("sim").desc(), id)
    found = None
    for block in _blocks(asked.filter(F.size("q") == dim).orderBy("search_id").toLocalIterator(), max(QUERY_VALUES // dim, 1)):
        near = rows.mapInArrow(_scorer(block, k, id, to_arrow_type(queries.schema["search_id"].dataType)), schema)
        near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        near = durable(near.select("search_id", "rank", id, "sim"))
        found = near if found is None else found.unionByName(near)
    return found


def _blocks(rows: Iterator, size: int) -> Iterator[dict]:
    """Query rows as {search_id: vectors}, whole searches, about ``size`` vectors each."""
    block, n = {}, 0
    for row in rows:
        if n >= size and row.search_id not in block:
            yield block
            block, n = {}, 0
        block.setdefault(row.search_id, []).append(row.q)
        n += 1
    if block:
        yield block


def _scorer(block: dict, k: int, id: str, key: pa.DataType):
    names = list(block)
    starts = np.cumsum([0, *(len(block[s]) for s in names[:-1])])
    q = np.asarray([v for s in names for v in block[s]], dtype=np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), EPS)

    def best_of(ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(sims) > k:  # all that tie with the k-th stay for the comparison of ids
            kept = sims >= np.partition(sims, len(sims) - k)[len(sims) - k]
            ids, sims = ids[kept], sims[kept]
        order = np.lexsort((ids, -sims))[:k]
        return ids[order], sims[order]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list = [None] * len(names)
        typ = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            typ = batch.schema.field(0).type
            ids = np.asarray(batch.column(0).to_pylist())
            mat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), EPS)
            sims = np.round(np.maximum.reduceat(mat @ q.T, starts, axis=1), SIM_DIGITS)
            for i in range(len(names)):
                mine, s = best_of(ids, sims[:, i])
                if top[i] is not None:
                    mine, s = best_of(np.concatenate([top[i][0], mine]), np.concatenate([top[i][1], s]))
                top[i] = (mine, s)
        for name, kept in zip(names, top):
            if kept is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(kept[0]), type=key), pa.array(kept[0].tolist(), type=typ), pa.array(kept[1])], names=["search_id", id, "sim"]
                )

    return score


def embedding_backlog(chunks: DataFrame, vectors: DataFrame, model: str, max_chars: int = MAX_EMBED_CHARS) -> DataFrame:
    """(chunk_id, input, left_out) of chunks without a vector of the model: title, section and text.

    The input is cut to the ``max_chars`` the model takes; ``left_out`` counts the characters beyond, so that nothing is
    left out unseen.
    """
    done = vectors.filter(F.col("model") == model).select("chunk_id")
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit(" | "), F.coalesce("section", F.lit("")), F.lit("\n"), "text")
    rows = chunks.join(done, "chunk_id", "left_anti").select("chunk_id", whole.alias("whole"))
    left_out = F.greatest(F.length("whole") - max_chars, F.lit(0)).cast("long")
    return rows.select("chunk_id", F.substring("whole", 1, max_chars).alias("input"), left_out.alias("left_out"))
