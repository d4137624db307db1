"""Exact top-k inner-product search by term-at-a-time accumulation.

Vectors become sparse integer rows. A task holds a chunk of candidates as postings, the rows and weights that each
dimension has, and a block of queries; for each dimension it scatters the queries' weights times the posting's into the
block's dense score arrays, selects the k best of the chunk by partition, and a last step merges the chunks' winners.
Every query meets every candidate, and no task holds more than one chunk and one block.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedprofile.llm.storage import materialize

#: Candidates of a chunk and queries of a block; one score array holds their product.
CHUNK_ROWS, BLOCK_ROWS, SCORED_AT_ONCE = 8192, 1024, 128
#: Dimensions that at least 1 / DENSE of the scores need are added as whole rows.
DENSE = 10


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """Rows ``(r, id, q)``, a row's number, its id and ``q = floor(scale * x)``; vectors that are null or hold null or
    non-finite components go, as do rows without an id."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad)
    return rows.select(F.monotonically_increasing_id().alias("r"), "id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("q"))


def _columns(rows: pd.Series, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the rows that have a weight there, and the weights."""
    sizes = rows.map(len).to_numpy()
    flat = np.concatenate(rows.to_list()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.flatnonzero(flat)
    some = some[np.argsort(dim[some], kind="stable")]
    cuts = np.searchsorted(dim[some], np.arange(dims + 1))
    return [(owner[some[a:b]], flat[some[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _most(columns: list[tuple[np.ndarray, np.ndarray]]) -> float:
    return max((float(np.abs(w).max(initial=0)) for _, w in columns), default=0.0)


def _accumulate(queries: list[tuple[np.ndarray, np.ndarray]], n_queries: int, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of all queries against all candidates, a dimension at a time."""
    kind = np.int32 if _most(queries) * _most(postings) * len(postings) < 2**31 else np.int64
    scores = np.zeros((n_queries, n), kind)
    part = np.empty_like(scores)
    for (asking, weights), (at, held) in zip(queries, postings, strict=True):
        weights, held = weights.astype(kind), held.astype(kind)
        if DENSE * len(asking) * len(at) >= n_queries * n:  # scattering weights into whole rows is cheaper than into the scores
            whole, every = np.zeros(n_queries, kind), np.zeros(n, kind)
            whole[asking], every[at] = weights, held
            np.multiply(whole[:, None], every[None, :], out=part)
            scores += part
        elif len(asking) and len(at):
            scores[np.ix_(asking, at)] += weights[:, None] * held[None, :]
    return scores.astype(np.int64)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column indexes of the k best of each row, in no order; ties to the lower column."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    if np.abs(scores).max(initial=0) < 2**40 and n < 2**22:
        keys = scores * n + (n - 1 - np.arange(n))
        return np.argpartition(keys, n - k, axis=1)[:, n - k :]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The k best inner products of each query row with all other rows: ``(query_id, rank, vec_id, score)``.

    ``is_query`` picks queries by the id, named ``id`` there. Ties go to the smaller id. Only the query's own row is left
    out: rows with a repeated id are candidates and queries each. Vectors of unlike length are compared over the shorter
    length, so that an empty vector scores 0. Rows without an id, null vectors and those with null or non-finite components
    take no part; an empty table, or one valid row, gives no rows; other columns are ignored.
    """
    rows = materialize(quantized(vectors, id_col, vec_col, scale))
    queries = rows.where(is_query)
    n_rows, n_queries = rows.count(), queries.count()
    chunks, blocks = max(1, -(-n_rows // CHUNK_ROWS)), max(1, -(-n_queries // BLOCK_ROWS))
    chunk, block = F.pmod(F.xxhash64("r"), F.lit(chunks)), F.pmod(F.xxhash64("r", F.lit(1)), F.lit(blocks))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    right = rows.select(chunk.alias("c"), F.explode(every(blocks)).alias("b"), "r", "id", "q")
    left = queries.select(F.explode(every(chunks)).alias("c"), block.alias("b"), "r", "id", "q")

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        outs = []
        if len(asked) and len(held):
            held = held.sort_values(["id", "r"], ignore_index=True)
            dims = int(max(held["q"].map(len).max(), asked["q"].map(len).max()))
            postings, ids, own_rows = _columns(held["q"], dims), held["id"].to_numpy(), held["r"].to_numpy()
            for at in range(0, len(asked), SCORED_AT_ONCE):
                some = asked.iloc[at : at + SCORED_AT_ONCE]
                scores = _accumulate(_columns(some["q"], dims), len(some), postings, len(held))
                # one more than k, because the query itself may be among them
                picked = _best(scores, k + 1)
                width = picked.shape[1]
                found = pd.DataFrame({
                    "query": np.repeat(some["r"].to_numpy(), width), "query_id": np.repeat(some["id"].to_numpy(), width),
                    "r": own_rows[picked.ravel()], "vec_id": ids[picked.ravel()], "score": np.take_along_axis(scores, picked, 1).ravel(),
                })
                outs.append(found[found["query"] != found["r"]].drop(columns="r"))
        return pd.concat(outs) if outs else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query", "query_id", "vec_id", "score")})

    kind = dict(rows.dtypes)["id"]
    near = left.groupBy("c", "b").cogroup(right.groupBy("c", "b")).applyInPandas(search, f"query long, query_id {kind}, vec_id {kind}, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
