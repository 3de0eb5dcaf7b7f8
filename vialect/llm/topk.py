"""Exact top-k by inner product, pruned by multi-resolution segment statistics.

A vector is described at several resolutions by the mean and the deviation of each of its segments. For two segments of
n components with means a, b and deviations s, t the inner product is at most n (a b + s t), which is the lower bound of
their distance by means and deviations, read as a similarity. Bounds are taken coarse to fine; a candidate goes on only
while its bound reaches the query's k-th best score so far, and exact scores are computed for the survivors. Candidates
come in falling order of their coarse bound, so a query ends as soon as that falls below its k-th best score. Ties are
kept, so results are exact.

Queries and candidates meet in a grid: a candidate belongs to one of C blocks, a query to one of Q, and each cell gets
one block of either; sizes of blocks are bounded, and the best k of each cell are merged. No cell begins without a bound:
every query is first scored against a small sample of all rows, and its k-th best score there goes with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Segments of each resolution, coarse to fine; rows of a block of candidates and of queries; rows bounded at a time.
SEGMENTS = (4, 16, 32)
CANDIDATES, QUERIES, CHUNK = 5_000, 2_000, 2048
#: Most rows, about, of the sample that gives queries their first bound; it is broadcast.
SEEDS = 2_000
SCALE = 1024
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each vector its segments' means and deviations, scaled so that a plain product of two rows is the bound."""
    dims = x.shape[1]
    edges = np.unique(np.linspace(0, dims, min(segments, dims) + 1).astype(int))
    n = np.diff(edges)
    total, squares = np.add.reduceat(x, edges[:-1], axis=1), np.add.reduceat(x * x, edges[:-1], axis=1)
    return np.concatenate([total / np.sqrt(n), np.sqrt(np.maximum(squares - total * total / n, 0))], axis=1)


def whole(vectors: list) -> np.ndarray:
    """floor(1024 x) of each component: doubles where all are exact and so are products of them, else Python's integers."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    if np.abs(x).max(initial=0) < 2.0**40:
        return np.floor(SCALE * x)
    return np.array([[int(a) * SCALE if abs(a) >= 2.0**53 else int(np.floor(a * SCALE)) for a in row] for row in x.tolist()], object)


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, seeds: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each query the ids and scores of its best k (ties to smaller ids) other than itself; and the exact products made.

    ``seeds`` are scores that k rows are known to reach; rows below them may be left out. Scores beyond a long count as
    the largest or smallest one.
    """
    huge = object in (queries.dtype, data.dtype)
    exact = not huge and np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(1, data.shape[1]) < 2**53
    if not huge:
        bound_q, bound_x = [statistics(queries, s) for s in SEGMENTS], [statistics(data, s) for s in SEGMENTS]
        slack = 1e-6 * (1 + np.abs(queries).sum(1) * np.abs(data).max(initial=0))
    best_ids, best, made = [], [], 0
    for i, q in enumerate(queries):
        top, top_ids, least = np.zeros(0, np.int64), np.zeros(0, np.int64), -np.inf if seeds is None else float(seeds[i])
        coarse = np.full(len(data), np.inf) if huge else bound_x[0] @ bound_q[0][i] + slack[i]
        order = np.argsort(-coarse, kind="stable")
        for rows in np.array_split(order, range(CHUNK // 8, len(data), CHUNK)) if len(data) else []:
            if len(rows) and coarse[rows[0]] < least:
                break
            rows = rows[(coarse[rows] >= least) & (ids[rows] != query_ids[i])]
            for fine_q, fine_x in zip(bound_q[1:], bound_x[1:], strict=True) if not huge else ():
                rows = rows[fine_x[rows] @ fine_q[i] + slack[i] >= least]
            if not len(rows):
                continue
            made += len(rows)
            if exact:
                scores = np.rint(data[rows] @ q).astype(np.int64)
            else:
                scores = np.array([max(_LEAST, min(_MOST, sum(int(a) * int(b) for a, b in zip(q, x, strict=True)))) for x in data[rows]], np.int64)
            top, top_ids = np.concatenate([top, scores]), np.concatenate([top_ids, ids[rows]])
            order_top = np.lexsort((top_ids, ~top))[:k]
            top, top_ids = top[order_top], top_ids[order_top]
            if len(top) == k:
                least = max(least, float(top[-1]) - (0 if exact else abs(float(top[-1])) * 1e-9))
        best_ids.append(top_ids)
        best.append(top)
    return best_ids, best, made


def top_k(df: DataFrame, key: str, vector: str, is_query: str, k: int = 10) -> DataFrame:
    """query_id, rank, the key of the match and its score, for each row of ``df`` for which the SQL ``is_query`` holds.

    Components x count as floor(1024 x). Rows with a null key, a null or empty vector, or a null or non-finite component
    take no part; rows equal in key and vector count once; only vectors of equal length are compared. A query never
    matches rows with its own key. Scores are exact; one beyond a long counts as the largest or smallest long, and such
    scores tie. An empty table gives no rows.
    """
    x = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double")).alias("v"), F.expr(is_query).alias("asks"))
    odd = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    x = x.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~odd).groupBy("id", "v").agg(F.max("asks").alias("asks"))
    sizes = df.select(F.count(F.lit(1)), F.count_if(F.expr(is_query))).head()
    blocks, parts = -(-max(1, sizes[0]) // CANDIDATES), -(-max(1, sizes[1]) // QUERIES)
    drawn = F.pmod(F.xxhash64(F.lit("seed"), "id"), F.lit(1 << 30)) < F.lit(int(min(1.0, SEEDS / max(1, sizes[0])) * (1 << 30)))
    seeds: dict[int, tuple[list, list]] = {}
    for r in x.filter(drawn).select("id", "v").collect() if blocks > 1 else []:  # about SEEDS rows
        held = seeds.setdefault(len(r["v"]), ([], []))
        held[0].append(r["v"])
        held[1].append(r["id"])
    shared = df.sparkSession.sparkContext.broadcast({n: (whole(v), np.array(ids, np.int64)) for n, (v, ids) in seeds.items()})

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries with the k-th best score of the sample, the least where it has fewer rows for them."""
        for rows in batches:
            least = np.full(len(rows), _LEAST, np.int64)
            sizes = rows["v"].map(len).to_numpy()
            for n in set(sizes.tolist()) & set(shared.value):
                at = np.flatnonzero(sizes == n)
                data, ids = shared.value[n]
                # Copies of a row under one id would count twice; then the sample has no bound to give.
                if len(set(ids.tolist())) < len(ids):
                    continue
                _, scores, _ = search(whole(rows["v"].iloc[at].tolist()), rows["id"].to_numpy(np.int64)[at], data, ids, k)
                least[at] = [s[-1] if len(s) == k else _LEAST for s in scores]
            yield rows.assign(least=least)

    asks = x.filter("asks").select("id", "v").mapInPandas(bounded, "id long, v array<double>, least long")
    # Both sides need keys of one type: Spark deals an int and a long of the same value to different partitions.
    asks = asks.withColumn("_q", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_n", F.size("v"))
    held = x.select("id", "v").withColumn("_c", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_n", F.size("v"))

    def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "match": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(queries) or not len(rows):
            return empty
        ids = queries["id"].to_numpy(np.int64)
        found, scores, _ = search(whole(queries["v"].tolist()), ids, whole(rows["v"].tolist()), rows["id"].to_numpy(np.int64), k, queries["least"].to_numpy(np.int64))
        return pd.DataFrame({"query_id": np.repeat(ids, [len(f) for f in found]), "match": np.concatenate(found), "score": np.concatenate(scores).astype(np.int64)})

    cells = asks.groupBy("_q", "_c", "_n").cogroup(held.groupBy("_q", "_c", "_n")).applyInPandas(meet, "query_id long, match long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "match")
    ranked = cells.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("match").alias(key), "score")
