"""Nearest neighbours by a permutation index.

Every vector is represented by its ``prefix`` nearest of ``pivots`` pivot
vectors, in order of nearness.  A block of the index holds an inverted file:
for each pivot the vectors that have it, with its place.  A query reads the
files of its own pivots and accumulates the footrule distance of the two
orders (a pivot that one of them lacks stands at place ``prefix``); the
closest share of the block is reranked by exact cosine.

The pivots are a bounded sample (``pivots`` of ``4 * pivots`` rows by a hash of
the id, copies left out); the index holds every row.  Vectors of different
lengths are not compared; blocks of another length than the most frequent one
take their pivots from their own rows.  Queries and rows meet
in blocks of bounded size; each pair of blocks gives at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, staged


def usable(vec: str) -> str:
    """SQL: the vector has components, all there and finite, not all zero."""
    return (f"{vec} IS NOT NULL AND size({vec}) > 0 AND forall({vec}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
            f"AND exists({vec}, x -> x <> 0)")


def matrix(packed: pd.Series) -> np.ndarray:
    return np.vstack([np.frombuffer(b, np.float64) for b in packed]) if len(packed) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow, no underflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def order_of(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the smaller
    number.  Row by row sums, so equal vectors get equal orders."""
    u = unit(x)
    near = np.stack([(u * p).sum(axis=1) for p in pivots], axis=1)
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.uint16)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor
    vanish and no digit of a cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    dots = (rows * query).sum(axis=1)
    return dots / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def inverted(orders: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the rows that have it and its place in each."""
    flat = orders.ravel()
    by = np.argsort(flat, kind="stable")
    ends = np.searchsorted(flat[by], np.arange(pivots + 1))
    rows, place = by // orders.shape[1], by % orders.shape[1]
    return [(rows[a:b], place[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def search_block(ids: np.ndarray, x: np.ndarray, orders: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 query_orders: np.ndarray, pivots: int, k: int, share: float) -> list[tuple[int, int, float]]:
    """(query, id, score) of the best k of a block for each query."""
    by_id = np.argsort(ids, kind="stable")
    ids, x, orders, queries = ids[by_id], scaled(x[by_id]), orders[by_id], scaled(queries)
    files, prefix = inverted(orders, pivots), orders.shape[1]
    most = min(len(ids), max(int(np.ceil(share * len(ids))), 16 * k) + 1)  # one more: the query itself
    out = []
    for q, vec, order in zip(query_ids, queries, query_orders):
        # footrule = prefix * (prefix + 1) - 2 * shared
        shared = np.zeros(len(ids), np.int32)
        for at, pivot in enumerate(order):
            rows, place = files[pivot]
            shared[rows] += prefix - np.maximum(place, at)
        near = np.argsort(-shared, kind="stable")[:most]  # ties: smaller id first
        near = near[ids[near] != q]
        score = cosine(x[near], vec)
        for i in np.lexsort((ids[near], -score))[:k]:
            out.append((q, ids[near][i], score[i]))
    return out


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            pivots: int = 256, prefix: int = 64, share: float = 0.1, block: int = 4096, query_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found by cosine for
    each query row (same columns as ``df``), ties to the smaller id.

    A row is never its own neighbour (equal id).  Vectors that are null, zero,
    or hold null or non-finite components and rows with a null id take no part.
    A query finds vectors of its own length.  An id given several times is found
    once, and asks once, with its best scores.  An empty table gives no rows.
    """
    spark = df.sparkSession
    ship(spark)

    def clean(d: DataFrame) -> DataFrame:
        return d.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")) \
            .where("id IS NOT NULL").where(usable("vec"))

    rows = clean(df)
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    shape = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], shape)
    dim, total = lengths[0]["dim"], lengths[0]["count"]
    asked = clean(queries).distinct()
    sample = [np.array(r["vec"], np.float64) for r in rows.where(F.size("vec") == dim).orderBy(F.xxhash64("id", F.lit(29)), "vec").limit(4 * pivots).collect()]
    points = unit(np.unique(np.vstack(sample), axis=0))
    chosen = points[np.random.default_rng(5).permutation(len(points))[:pivots]]
    prefix = min(prefix, len(chosen))
    shared = spark.sparkContext.broadcast(chosen)  # pivots x dim numbers

    def pack(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            if len(pdf):
                vectors = [np.asarray(v, np.float64) for v in pdf["vec"]]
                dims = np.array([len(v) for v in vectors])
                orders = np.full(len(pdf), b"", object)
                main = np.flatnonzero(dims == dim)
                if len(main):
                    orders[main] = [o.tobytes() for o in order_of(np.vstack([vectors[i] for i in main]), shared.value, prefix)]
                yield pd.DataFrame({"id": pdf["id"], "dim": dims, "vec": [v.tobytes() for v in vectors], "orders": orders})

    blocks = -(-total // block)  # no other length has more rows
    asked = staged(asked, "queries")
    query_blocks = max(1, -(-asked.count() // query_block))
    packed = "id long, dim int, vec binary, orders binary"
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.mapInPandas(pack, packed).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")) \
        .withColumn("qblock", every(query_blocks))
    probes = asked.mapInPandas(pack, packed).withColumn("qblock", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks)).cast("int")) \
        .withColumn("block", every(blocks))
    n_pivots = len(chosen)

    def meet(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asked):
            ids, x, queries = data["id"].to_numpy(), matrix(data["vec"]), matrix(asked["vec"])
            if data["dim"].iloc[0] == dim:
                ints = lambda s: np.vstack([np.frombuffer(b, np.uint16) for b in s])
                orders, asked_orders, n = ints(data["orders"]), ints(asked["orders"]), n_pivots
            else:
                own = unit(x[np.lexsort((x[:, 0], ids))[:pivots]])
                n = len(own)
                orders, asked_orders = order_of(x, own, min(prefix, n)), order_of(queries, own, min(prefix, n))
            out = search_block(ids, x, orders, asked["id"].to_numpy(), queries, asked_orders, n, k, share)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = index.groupBy("dim", "block", "qblock").cogroup(probes.groupBy("dim", "block", "qblock")) \
        .applyInPandas(meet, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
