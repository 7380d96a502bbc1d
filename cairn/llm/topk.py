"""Exact top-k by inner product in three phases with a uniform threshold.

Every vector is cut into `lists` runs of dimensions; a score is the sum of the
runs' partial scores.  Phase 1 looks at every PROBE-th candidate of each block
only and gathers, for every query, the k best entries of each run's list with
their full scores; the k-th best over all blocks is a cutoff that the true
result cannot fall below.  Phase 2 sends the cutoff with the queries.  A block
adds up the runs' partial scores in turn and drops an entry as soon as the
runs still to come, bounded by the norms of both vectors there, can't bring it
to the cutoff; once few are left only those are multiplied.  An entry that
reaches the cutoff has a partial score of cutoff / lists or more, so what is
left is sufficient.  Phase 3 resolves the remaining scores exactly and keeps
the best.  Queries and candidates meet in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint

#: Scores of one step of a block: queries at once times candidates.
CELLS = 1 << 20
#: Phase 1 looks at one in so many candidates.
PROBE = 8
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def as_matrix(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows as one matrix of whole numbers; shorter rows end in zeros."""
    width = width if width is not None else max(map(len, column), default=0)
    out = np.zeros((len(column), width), np.int64)
    for i, row in enumerate(column):
        out[i, : len(row)] = row
    # Doubles multiply exactly, and faster, while sums of products stay below 2^53.
    peak = max(int(out.max(initial=0)), -int(out.min(initial=0)))
    return out.astype(np.float64) if peak * peak * max(width, 1) < 1 << 53 else out.astype(object) if peak * peak * max(width, 1) >= 1 << 63 else out


def as_longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([min(max(int(x), LOWEST), HIGHEST) for x in scores], np.int64)
    return scores.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Block:
    """Vectors in runs of dimensions, with the norm of each run."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, lists: int):
        self.vectors, self.ids = vectors, ids
        self.cuts = np.linspace(0, vectors.shape[1], lists + 1).astype(int)
        self.norms = np.stack([np.sqrt(np.square(vectors[:, a:b].astype(float)).sum(axis=1)) for a, b in self.runs()], 1)

    def runs(self):
        return zip(self.cuts[:-1], self.cuts[1:])


def sufficient(q: Block, c: Block, cutoff: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """(query, candidate, score) of every pair whose score reaches the query's cutoff (NaN: all), by position; and how many entries were collected for it."""
    low = np.where(np.isnan(cutoff), -np.inf, cutoff)
    lists = len(q.cuts) - 1
    # A little below the exact threshold, as it is a rounded quotient.
    threshold = low / lists - 1e-9 * np.abs(np.where(np.isinf(low), 0, low)) - 1e-6
    found, partial = np.zeros((len(low), len(c.ids)), bool), []
    for j, (a, b) in enumerate(q.runs()):
        # No product of a run is above that of the norms.
        able = q.norms[:, j] * c.norms[:, j].max(initial=0) * (1 + 1e-9) + 1 >= threshold
        with np.errstate(over="ignore"):
            least = np.min(np.where(able & (threshold > 1), (threshold - 1) / np.maximum(q.norms[:, j] * (1 + 1e-9), 1e-300), np.where(able, -np.inf, np.inf)), initial=np.inf)
        wide = c.norms[:, j] >= least
        whole = able.all() and wide.all()
        rows, cols = (slice(None), slice(None)) if whole else (np.flatnonzero(able), np.flatnonzero(wide))
        part = q.vectors[rows, a:b] @ c.vectors[cols, a:b].T
        partial.append(part if whole else None)
        hit = part >= threshold[rows][:, None]
        if whole:
            found |= hit
        else:
            i, k = np.nonzero(hit)
            found[rows[i], cols[k]] = True
    rows, cols = np.nonzero(found)
    score = np.add.reduce([p[rows, cols] if p is not None else (q.vectors[rows, a:b] * c.vectors[cols, a:b]).sum(axis=1) for p, (a, b) in zip(partial, q.runs())])
    reach = score >= low[rows]
    return (rows[reach], cols[reach], score[reach]), len(rows)


def local_lists(q: Block, c: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score), by position, of the k best candidates of every run's list."""
    partial = [q.vectors[:, a:b] @ c.vectors[:, a:b].T for a, b in q.runs()]
    rows, cols = [], []
    for i in range(len(q.ids)):
        at = np.flatnonzero(c.ids != q.ids[i])
        at = np.unique(np.concatenate([at[best(p[i][at], c.ids[at], k)] for p in partial]))
        rows.append(np.full(len(at), i))
        cols.append(at)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    return rows, cols, np.add.reduce([p[rows, cols] for p in partial])


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int, lists: int, final: bool) -> pd.DataFrame:
    """Phase 1 (final: phases 2 and 3) of one block of queries against one block of candidates."""
    width = max(max(map(len, queries["v"]), default=0), max(map(len, rows["v"]), default=0))
    q, c = as_matrix(queries["v"], width), as_matrix(rows["v"], width)
    if q.dtype != c.dtype:
        kind = object if object in (q.dtype, c.dtype) else np.int64
        q, c = q.astype(kind), c.astype(kind)
    ids, qids = rows["id"].to_numpy(np.int64), queries["id"].to_numpy(np.int64)
    cutoff = queries["cutoff"].to_numpy(float)
    whole = Block(c, ids, lists)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, CELLS // max(1, len(ids)))
    for i in range(0, len(qids), step):
        part = Block(q[i : i + step], qids[i : i + step], lists)
        at, col, score = sufficient(part, whole, cutoff[i : i + step])[0] if final else local_lists(part, whole, k)
        other = ids[col] != part.ids[at]
        at, col, score = at[other], col[other], as_longs(score[other])
        order = np.lexsort((ids[col], ~score, at))
        at, col, score = at[order], col[order], score[order]
        first = np.searchsorted(at, at)
        top = np.arange(len(at)) - first < k
        out.append((part.ids[at[top]], ids[col[top]], score[top]))
    cat = lambda n: np.concatenate([x[n] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64)
    return pd.DataFrame({"query_id": cat(0), "vec_id": cat(1), "score": cat(2)})


def whole_number(x: Column) -> Column:
    """Floor as a long; beyond its range the nearest."""
    return F.when(x >= 2.0**63, F.lit(HIGHEST)).when(x < -(2.0**63), F.lit(LOWEST)).otherwise(F.floor(F.when(F.abs(x) < 2.0**63, x).otherwise(0.0)).cast("long"))


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, lists: int = 4, block: int = 65536, query_block: int = 32768, tasks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest integer inner product for every query.

    is_query: a condition over vectors.  Components are floor(scale * x).
    Every row but the query's own id is a candidate; ties go to the smaller
    id.  Vectors that are null, or hold a null, NaN or infinite component,
    and rows with a null id take no part.  Vectors of unequal length are
    padded with zeros.  Rows repeated under one id are candidates each, and
    queries each, whose results are ranked together.  Components and scores beyond the range of a long count as its
    nearest value.  Empty tables, and tables without queries, give no rows.
    Other columns are not read, so their names don't matter.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), sound.alias("ok"), x.alias("x")).filter("ok")
    rows = checkpoint(rows.select("id", F.coalesce("q", F.lit(False)).alias("q"), F.transform("x", lambda v: whole_number(v * scale)).alias("v")))
    n, nq = rows.agg(F.count("*"), F.count_if("q")).first()
    tasks = tasks or spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(2 * tasks, n // 512))
    query_blocks = max(1, -(-nq // query_block))
    slot = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    cands = rows.select("id", "v", slot(blocks).alias("cb"), every(query_blocks).alias("qb"))
    queries = rows.filter("q").select("id", "v", slot(query_blocks).alias("qb"))

    # Every PROBE-th candidate by a hash of its id, or all of a small table.
    probed = cands.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PROBE)) == 0) if n >= PROBE * PROBE * k else cands

    def phase(queries: DataFrame, final: bool) -> DataFrame:
        placed = queries.withColumn("cb", every(blocks))
        return placed.groupBy("cb", "qb").cogroup((cands if final else probed).groupBy("cb", "qb")).applyInPandas(
            lambda a, b: search_block(a, b, k, lists, final) if len(a) and len(b) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64"),
            "query_id long, vec_id long, score long",
        )

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    local = phase(queries.withColumn("cutoff", F.lit(None).cast("double")), False)
    cutoff = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("cutoff"))
    known = checkpoint(queries.join(cutoff, queries["id"] == cutoff["query_id"], "left").select("id", "v", "qb", "cutoff"))
    exact = phase(known, True)
    return exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
