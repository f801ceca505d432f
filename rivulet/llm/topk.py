"""Exact top-k search by inner product, in three phases with one uniform threshold a query.

Vectors lie in cells, queries in blocks; every cell meets every block once (a stated query set against all rows). A score is
the sum of ``LISTS`` lists, one for each run of components.
1. Each cell ranks its rows by each list and sends the whole scores of the lists' best k: the local score lists.
2. The k-th best of the merged lists is a safe cutoff T for the query, as at least k rows reach it. It is sent back to all cells.
   A row whose share of every list is below T / ``LISTS`` can't reach it, so the cells collect those with one list that does.
3. Only their scores are resolved, exactly, and the best k of all are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows a cell, queries a block: what meets in one task.
CELL, BLOCK = 8192, 4096
#: Lists that a score is the sum of. With more of them the uniform threshold is lower, so more rows are collected.
LISTS = 2
#: Queries that meet a cell's rows at a time.
STEP = 256


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of doubles as rows of one matrix, shorter ones closed with zeros."""
    arrays = vectors.combine_chunks()
    flat, ends = arrays.flatten().to_numpy(zero_copy_only=False), arrays.value_lengths().to_numpy(zero_copy_only=False)
    if len(ends) and (ends == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(ends), width))
    out[np.arange(width) < ends[:, None]] = flat
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles: by BLAS where every sum is exact in doubles, else as Python integers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2.0**53:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return whole(q) @ whole(x).T


def _lists(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """What each run of components adds to the scores."""
    cuts = [q.shape[1] * j // LISTS for j in range(LISTS + 1)]
    return [_products(q[:, i:j], x[:, i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _long(score) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


def _beyond(score) -> bytes | None:
    """Orders scores that 64 bits can't hold and that are all given as the nearest one: larger numbers have larger bytes."""
    n = int(score)
    if -(2**63) < n < 2**63 - 1:
        return None
    size = abs(n).bit_length() // 8 + 1
    raw = size.to_bytes(2, "big") + abs(n).to_bytes(size, "big")
    return raw if n > 0 else bytes(255 - x for x in raw)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def _one_each(t: pa.Table) -> pa.Table:
    """One row an id: of several, the one with the smallest vector."""
    if len(t) == len(pc.unique(t["id"])):
        return t
    seen: dict[int, tuple] = {}
    for i, (name, v) in enumerate(zip(t["id"].to_pylist(), t["v"].to_pylist(), strict=True)):
        if name not in seen or v < seen[name][0]:
            seen[name] = (v, i)
    return t.take(sorted(i for _, i in seen.values()))


def _pairs(left: pa.Table, right: pa.Table):
    """Queries and rows of a cell as ids and matrices."""
    queries, rows = _one_each(left), _one_each(right)
    width = max([0, *(pc.max(pc.list_value_length(t["v"])).as_py() or 0 for t in (queries, rows))])
    return queries["id"].to_numpy(), _matrix(queries["v"], width), rows["id"].to_numpy(), _matrix(rows["v"], width), queries


def _result(query: list, ids: list, scores: list) -> pa.Table:
    join = lambda x: np.concatenate(x).tolist() if x else []
    flat = join(scores)
    return pa.table({"query_id": pa.array(join(query), pa.int64()), "vec_id": pa.array(join(ids), pa.int64()), "score": pa.array(map(_long, flat), pa.int64()), "beyond": pa.array(map(_beyond, flat), pa.binary())})


def local_lists(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """Phase 1: queries, rows and whole scores of each list's best k rows."""
    out: tuple[list, list, list] = ([], [], [])
    for i in range(0, len(qid) if len(xid) else 0, STEP):
        lists = _lists(q[i : i + STEP], x)
        total = sum(lists[1:], lists[0])
        for j in range(len(total)):
            mine = qid[i + j]
            at: np.ndarray = np.empty(0, np.int64)
            for part in lists:
                order = np.argsort if part.dtype == object else (lambda v: np.argpartition(v, len(v) - k - 1))
                top = np.arange(len(xid)) if len(xid) <= k + 1 else order(part[j])[len(xid) - k - 1 :]
                at = np.union1d(at, top[xid[top] != mine])
            out[0].append(np.full(len(at), mine))
            out[1].append(xid[at])
            out[2].append(total[j][at])
    return out


def collected(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, cutoff: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """Phases 2 and 3: of the rows with one list that reaches its part of the cutoff, the best k; and how many rows those were."""
    out: tuple[list, list, list] = ([], [], [])
    kept = 0
    for i in range(0, len(qid) if len(xid) else 0, STEP):
        lists = _lists(q[i : i + STEP], x)
        least = cutoff[i : i + STEP, None] / LISTS
        able = np.logical_or.reduce([part >= least for part in lists])
        for j in range(len(able)):
            at = np.flatnonzero(able[j])
            at = at[xid[at] != qid[i + j]]
            kept += len(at)
            scores = sum((part[j][at] for part in lists[1:]), lists[0][j][at])
            best = _best(xid[at], scores, k)
            out[0].append(np.full(len(best), qid[i + j]))
            out[1].append(xid[at][best])
            out[2].append(scores[best])
    return (*out, kept)


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding", scale: int = 64, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long) of the ``k`` rows with the highest inner product of floor(scale * x).

    A query's own id is no candidate; ties go to the smaller vec_id. Rows take no part if the id or vector is null or a
    component is null or not finite. An id that repeats counts once, with its smallest vector. Vectors of several lengths
    are closed with zeros. With no candidates there are no rows. Other columns are ignored.
    """
    def usable(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector), lambda x: x.cast("double"))
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col(id).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))

    rows, asked = usable(vectors), usable(queries)
    n, m = vectors.count(), queries.count()
    cells, blocks = max(1, -(-n // cell)), max(1, -(-m // block))
    spread = lambda of, count: F.pmod(F.xxhash64(of), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    right = rows.select(spread("id", cells).alias("cell"), every(blocks).alias("block"), "id", "v").repartition(cells * blocks, "cell", "block")
    left = asked.select(every(cells).alias("cell"), spread("id", blocks).alias("block"), "id", "v")

    def scaled(m: np.ndarray) -> np.ndarray:
        return np.floor(scale * m.astype(np.float64))

    def local(a: pa.Table, b: pa.Table) -> pa.Table:
        qid, q, xid, x, _ = _pairs(a, b)
        return _result(*local_lists(qid, scaled(q), xid, scaled(x), k))

    def final(a: pa.Table, b: pa.Table) -> pa.Table:
        qid, q, xid, x, kept = _pairs(a, b)
        cutoff = kept["cutoff"].to_numpy(zero_copy_only=False).astype(np.float64)  # a query with fewer than k scores has none: -inf
        return _result(*collected(qid, scaled(q), xid, scaled(x), cutoff, k)[:3])

    kind = "query_id long, vec_id long, score long, beyond binary"
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    lists = left.repartition(cells * blocks, "cell", "block").groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(local, kind)
    cutoffs = written(spark, lists.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff")), "cutoffs")
    told = left.join(cutoffs, "id", "left").select("cell", "block", "id", "v", F.when(F.col("cutoff") > -(2**63), F.col("cutoff").cast("double") - F.abs(F.col("cutoff")) * 1e-15).otherwise(F.lit(float("-inf"))).alias("cutoff")).repartition(cells * blocks, "cell", "block")
    entries = told.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(final, kind)
    best = entries.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_three_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(spark, vectors, vectors.filter(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op8_three_phase": op8_three_phase}
ORACLES = {"op8_three_phase": ORACLE}
