"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are hashed by their direction, so that no vector's bucket depends on
another's length.  A table turns all vectors by three rounds of random signs and
a fast Hadamard transform; a vector's bucket is the signed axis it is nearest
to.  A query looks into its ``probes`` nearest buckets of each table; what it
meets there is scored by its inner product, in double precision.  A query that
meets fewer than ``k + 1`` different vectors is scored against all of them.

Equal vectors are searched once: of a group only the ``k + 1`` smallest ids can
be among anyone's ``k`` nearest (ties go to smaller ids).  A bucket's vectors
and its queries are both cut into blocks, and every pair of blocks is a group of
its own, so that a bucket that holds a third of all rows is no single task's.

Vectors that are null, zero, or hold a null, NaN or infinite component take no
part, nor do rows with a null id; vectors of unlike lengths never meet.  Rows
with one id are one candidate each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesmart.llm.common import grouped, ship
from salesmart.session import cut

TABLES, PROBES, SEED = 28, 8, 7
BUCKET_BLOCK, QUERY_BLOCK = 2048, 4096
SLACK = 4
PAIRS_AT_ONCE = 100_000
MERGE_ROWS = 200_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The rows' fast Hadamard transform (length a power of two), unscaled."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(n, d)
        h *= 2
    return x


def axes(x: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(table, row, probe): the nearest signed axes, nearest first."""
    width = 1 << (x.shape[1] - 1).bit_length()
    probes = min(probes, 2 * width)
    padded = np.zeros((len(x), width))
    padded[:, :x.shape[1]] = x
    rng = np.random.default_rng([seed, width])
    out = np.empty((tables, len(x), probes), np.int64)
    for t in range(tables):
        turned = padded
        for _ in range(3):
            turned = hadamard(turned * rng.choice([-1.0, 1.0], width))
        both = np.concatenate([turned, -turned], 1)
        if probes == 1:
            out[t, :, 0] = both.argmax(1)
        else:
            best = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
            out[t] = best
    return out


def _vectors(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES,
            seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` found nearest of every query row.

    ``vectors`` has vec_id and embedding; ``is_query`` chooses the queries among its rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    sound = (vectors.select("vec_id", "embedding", is_query.alias("is_query"))
             .where("vec_id IS NOT NULL AND embedding IS NOT NULL")
             .where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
             .where(F.exists("embedding", lambda x: x != 0)))
    first = Window.partitionBy("embedding").orderBy("vec_id")
    members = sound.withColumn("place", F.row_number().over(first)).where(f"place <= {k + 1}")
    groups = sound.groupBy("embedding").agg(F.min("vec_id").cast("long").alias("rep"), F.max("is_query").alias("asks"))
    # rows that share an id are told apart by the vector as well
    groups = cut(groups.withColumns({"key": F.xxhash64("embedding"), "width": F.size("embedding")}))

    def hashed(batches):
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                for start in range(0, part.num_rows, 1024):
                    yield from _hash(part.slice(start, 1024), int(width))

    def _hash(part, width):
        x = _vectors(part.column("embedding"), width)
        x = x / np.abs(x).max(1, keepdims=True)      # first by the largest component, whose square may overflow
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        rows = np.arange(part.num_rows)
        asks = np.flatnonzero(part.column("asks").to_numpy(zero_copy_only=False))
        own = axes(x, tables, 1, seed)
        seen = axes(x[asks], tables, probes, seed)
        source = np.concatenate([np.tile(rows, tables), np.tile(np.repeat(asks, seen.shape[2]), tables)])
        table = np.concatenate([np.repeat(np.arange(tables), len(rows)), np.repeat(np.arange(tables), seen[0].size)])
        kind = np.repeat([0, 1], [tables * len(rows), seen.size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(source * 0 + width), pa.array(table), pa.array(np.concatenate([own.ravel(), seen.ravel()])),
             pa.array(kind), part.column("key").take(pa.array(source)), part.column("rep").take(pa.array(source)),
             part.column("embedding").take(pa.array(source))],
            names=["width", "table", "bucket", "kind", "key", "rep", "embedding"])

    vector_type = vectors.schema["embedding"].dataType.simpleString()
    placed = groups.select("key", "rep", "width", "asks", "embedding").mapInArrow(
        hashed, f"width long, table long, bucket long, kind long, key long, rep long, embedding {vector_type}")
    place = ["width", "table", "bucket"]
    keys = [*place, "block", "query_block"]

    def search(batches):
        found: list[tuple] = []
        rows = 0
        for (width, *_), group in grouped(batches, keys):
            kind = group.column("kind").to_numpy()
            if kind[0] == kind[-1]:
                continue
            key, rep = group.column("key").to_numpy(), group.column("rep").to_numpy()
            x, split = _vectors(group.column("embedding"), width), int((kind == 0).sum())
            for start in range(split, len(kind), 512):
                found.append(_best(key[:split], rep[:split], x[:split], key[start:start + 512], x[start:start + 512], k))
                rows += len(found[-1][0])
            if rows > MERGE_ROWS:
                found = [_merge(found, k)]
                rows = len(found[0][0])
                if rows > MERGE_ROWS // 2:
                    yield _batch(found[0])
                    found, rows = [], 0
        if found:
            yield _batch(_merge(found, k))

    def best_met(placed, hint=lambda blocks: blocks):
        """Each query's first groups among those it shares a place with."""
        n_held, n_asking = F.count_if(F.col("kind") == 0), F.count_if(F.col("kind") == 1)
        blocks = placed.groupBy(*place).agg(
            F.ceil(n_held / BUCKET_BLOCK).cast("int").alias("blocks"),
            F.ceil(n_asking / QUERY_BLOCK).cast("int").alias("query_blocks")).where("blocks > 0 AND query_blocks > 0")
        own = F.pmod(F.xxhash64("key"), F.when(F.col("kind") == 0, F.col("blocks")).otherwise(F.col("query_blocks")))
        every = F.explode(F.sequence(
            F.lit(0), F.when(F.col("kind") == 0, F.col("query_blocks")).otherwise(F.col("blocks")) - 1))
        dealt = placed.join(hint(blocks), place).withColumns({"own": own.cast("int"), "every": every}).withColumns({
            "block": F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("every")),
            "query_block": F.when(F.col("kind") == 0, F.col("every")).otherwise(F.col("own"))})
        dealt = dealt.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, "kind")
        met = dealt.select(*keys, "kind", "key", "rep", "embedding").mapInArrow(
            search, "query long, other long, rep long, score double")
        return (met.repartition("query").groupBy("query", "other", "rep").agg(F.max("score").alias("score"))
                .withColumn("place", F.row_number().over(
                    Window.partitionBy("query").orderBy(F.desc("score"), "rep", "other")))
                .where(f"place <= {k + SLACK}").drop("place", "rep"))

    best = cut(best_met(placed))
    served = best.groupBy("query").count().where(F.col("count") > k).select("query")
    short = groups.where("asks").join(served, F.col("key") == F.col("query"), "left_anti")
    if not short.isEmpty():
        # one place for all vectors of a width; a row of block counts for each width
        whole = groups.withColumn("kind", F.lit(0)).unionByName(short.withColumn("kind", F.lit(1))).select(
            F.col("width").cast("long").alias("width"), F.lit(0).cast("long").alias("table"),
            F.lit(0).cast("long").alias("bucket"), F.col("kind").cast("long").alias("kind"), "key", "rep", "embedding")
        best = best.join(served, "query", "left_semi").unionByName(best_met(whole, F.broadcast))
    ids = members.select(F.xxhash64("embedding").alias("other"), "vec_id")
    # the k + 1 nearest rows of each distinct query vector, then each query row without itself
    near = (best.join(ids, "other").withColumn("place", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(f"place <= {k + 1}"))
    asking = sound.where("is_query").select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query"))
    return (asking.join(near, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))).where(f"rank <= {k}")
        .select("query_id", "rank", "vec_id", "score"))


def _best(key, rep, x, query_key, q, k):
    """(query, other, rep, score) of each query's nearest in one block; scores do not depend on the block.

    Fast products choose with a margin for their rounding, so that equal scores
    are all met; the order is by exact scores, ties by the least id.
    """
    rough = q @ x.T
    n = min(k + SLACK, len(key))
    least = np.partition(rough, len(key) - n, axis=1)[:, len(key) - n]
    margin = 1e-12 * np.sqrt((q * q).sum(1) * (x * x).sum(1).max())
    row, column = np.nonzero(rough >= (least - margin)[:, None])
    exact = np.concatenate([(q[row[i:i + PAIRS_AT_ONCE]] * x[column[i:i + PAIRS_AT_ONCE]]).sum(1)
                            for i in range(0, len(row), PAIRS_AT_ONCE)])
    return _first(query_key[row], key[column], rep[column], exact, k, row)


def _first(query, other, rep, score, k, row=None):
    """The ``k`` and some more first of each query."""
    order = np.lexsort((other, rep, -score, query if row is None else row))
    query, other, rep, score = query[order], other[order], rep[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (other[1:] != other[:-1])    # one pair, one score
    query, other, rep, score = query[new], other[new], rep[new], score[new]
    start = np.ones(len(query), bool)
    start[1:] = query[1:] != query[:-1]
    first = np.maximum.accumulate(np.where(start, np.arange(len(query)), 0))
    best = np.arange(len(query)) - first < k + SLACK
    return query[best], other[best], rep[best], score[best]


def _merge(found, k):
    return _first(*(np.concatenate(c) for c in zip(*found)), k)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["query", "other", "rep", "score"])
