"""Most similar vectors for a stated query set: the queries in blocks against all rows.

Each task compares a part of the rows with a block's queries and passes on its k best of each query; these are merged.  The
rows are read once, and a task holds one block, which is bounded; nothing comes to the driver.  Vectors that are null, of another width,
not finite or all zero take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, PARTS = 8192, 64


def _units(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return batch.column(0).to_numpy()[ok], x[ok] / norm[ok][:, None]


def _search_blocks(width: int, k: int):
    """Rows arrive by block and part, the queries (kind 0) first."""

    def best(ids: np.ndarray, queries: np.ndarray, key: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(queries), 1024):
            sim = np.round(queries[a : a + 1024] @ x.T, 6)
            sim[ids[a : a + 1024, None] == key[None]] = -2
            order = np.lexsort((np.broadcast_to(key, sim.shape), -sim), axis=1)[:, :k]
            top = np.take_along_axis(sim, order, 1)
            ok = top > -2
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a : a + 1024], ok.sum(1))), pa.array(key[order[ok]]), pa.array(top[ok])], names=["query_id", "id", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, queries = None, np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1) if len(batch) else np.zeros((0, 3), np.int64)
            edges = np.append(np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(1))), len(place)) if len(place) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if at != tuple(place[a, :2]):
                    at, ids, queries = tuple(place[a, :2]), np.zeros(0, np.int64), np.zeros((0, width))
                key, x = _units(pa.RecordBatch.from_arrays([batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a)], names=["id", "v"]), width)
                if place[a, 2] == 0:
                    ids, queries = np.append(ids, key), np.concatenate([queries, x])
                elif len(ids) and len(key):
                    yield from best(ids, queries, key, x)

    return run


def top_k(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, width: int = 64) -> DataFrame:
    """query_id, id, similarity, rank. queries: rows of the same columns, taken in blocks of about QUERY_BLOCK.

    All blocks lie in one small table of the shared folder, a row for each; every task of the one scan over the rows meets each block in turn, a block at a time in memory.
    """
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == width)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    stated = queries.where(F.col(key).isNotNull() & (F.size(vector) == width)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    total = stated.count()
    empty = df.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double, rank int")
    if not total:
        return empty
    blocks = -(-total // QUERY_BLOCK)
    # a stated query set against all rows: each part of the rows is sent to the tasks of all blocks, so that the rows are read once
    cut = stated.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    sent = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    both = sent.select("block", "part", F.lit(1).alias("kind"), "id", "v").unionByName(asked.select("block", "part", F.lit(0).alias("kind"), "id", "v"))
    both = both.repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    best = both.mapInArrow(_search_blocks(width, k), "query_id bigint, id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
