"""Near-duplicate vectors by cross-polytope hashing.

A hash turns a vector by three rounds of random signs and a fast Hadamard transform and names the signed axis
nearest to it. A table joins HASHES of them; each vector also enters the next best buckets (multiprobe). Vectors of
one bucket and label are compared by cosine in double precision, in square blocks of bounded size. A pair that
meets in several buckets counts in the first only, and what leaves a block is one row per vector: how many it
links with there, and the smallest vector of its part of the block. Equal vectors are one class throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedprofile.llm.components import connected_components
from feedprofile.llm.storage import mapped, materialize

#: Hash tables, buckets that a vector enters in each, and rows of a block.
TABLES, PROBES, BLOCK_ROWS = 10, 4, 1024
#: Hashes of a table: with three, vectors that do not resemble each other hardly ever share a bucket.
HASHES = 3
#: Small buckets are verified together, about so many rows a task group.
ROWS_TOGETHER = 4000


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, width, h = x.shape[0], x.shape[1], 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return x


def bucket_keys(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = 17) -> np.ndarray:
    """Bucket numbers, ``n x tables x probes``, best first; rows of ``vectors`` have length one."""
    n, d = vectors.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = vectors
    rng = np.random.default_rng([seed, width])
    out = np.empty((n, tables, probes), np.int64)
    rows = np.arange(n)[:, None]
    for t in range(tables):
        axes, costs = [], []
        for _ in range(HASHES):
            x = padded
            for _ in range(3):
                x = _hadamard(x * rng.choice((-1.0, 1.0), width)) / np.sqrt(width)
            both = np.concatenate((x, -x), axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :probes]
            axes.append(best)
            costs.append((both[rows, best[:, :1]] - both[rows, best]) ** 2)
        cost, key = costs[0], axes[0]
        for more, axis in zip(costs[1:], axes[1:], strict=True):
            cost = (cost[:, :, None] + more[:, None, :]).reshape(n, -1)
            key = (key[:, :, None] * (2 * width) + axis[:, None, :]).reshape(n, -1)
        out[:, t] = np.take_along_axis(key, np.argsort(cost, axis=1, kind="stable")[:, :probes], 1)
    return out


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(batches):
    for batch in batches:
        ids, vectors = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v").to_pylist()
        by_length: dict[int, list[int]] = {}
        for k, v in enumerate(vectors):
            by_length.setdefault(len(v), []).append(k)
        for length, at in by_length.items():
            keys = bucket_keys(_unit([vectors[k] for k in at])).reshape(len(at), -1)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids[at]), "length": pa.array([length] * len(at), pa.int32()),
                "keys": pa.array(list(keys), pa.list_(pa.int64())),
            })


def _compare(left: dict, right: dict, table: int, key: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine at or above the threshold for which this is the first common bucket."""
    i, j = np.nonzero(left["x"] @ right["x"].T >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    # matrix products may differ from plain sums in the last bits; decide on plain sums
    exact = np.concatenate([np.einsum("ij,ij->i", left["x"][i[s : s + 65536]], right["x"][j[s : s + 65536]]) for s in range(0, len(i), 65536)])
    keep = exact >= threshold
    i, j = i[keep], j[keep]
    for t in range(table + 1):
        a, b = left["keys"][i, t], right["keys"][j, t]
        common = a[:, :, None] == b[:, None, :]
        if t == table:
            common &= (a < key)[:, :, None]
        keep = ~common.any(axis=(1, 2))
        i, j = i[keep], j[keep]
    return i, j


def _verify(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    ids, sizes = rows["id"].to_numpy(), rows["size"].to_numpy()
    keys = np.stack(rows["keys"].to_list()).reshape(len(rows), TABLES, -1)
    links, low = np.zeros(len(rows), np.int64), ids.copy()
    names = ["label", "length", "tab", "key", "lo", "hi"]
    for (_, _, table, key, lo, hi), part in rows.groupby(names, sort=False).indices.items():
        if len(part) < 2:
            continue
        held = lambda at: {"x": _unit(rows["v"].iloc[at]), "keys": keys[at]}
        if lo == hi:
            left = right = part
        else:
            mine = rows["part"].to_numpy()[part]
            left, right = part[mine == lo], part[mine == hi]
            if not len(left) or not len(right):
                continue
        i, j = _compare(held(left), held(right), int(table), int(key), threshold, lo == hi)
        if not len(i):
            continue
        a, b = left[i], right[j]
        np.add.at(links, a, sizes[b])
        np.add.at(links, b, sizes[a])
        while True:
            least = np.minimum(low[a], low[b])
            if (least == low[a]).all() and (least == low[b]).all():
                break
            np.minimum.at(low, a, least)
            np.minimum.at(low, b, least)
    out = pd.DataFrame({"id": ids, "links": links, "low": low})
    return out[out["links"] > 0]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Link vectors of equal label whose cosine reaches the threshold: ``(id_col, n_links, component_id, kept)``.

    ``n_links`` counts other rows linked directly, equal vectors included; ``component_id`` is the smallest id
    reachable. Null, empty and zero vectors, vectors with null or non-finite components, and rows with a null label
    link with nothing and form components of their own. Rows with a repeated id are vectors like any other. Vectors
    of unlike length never link. Other columns are ignored; an empty table gives no rows.
    """
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    sound = (
        F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.coalesce(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(False))
        & F.coalesce(F.exists("v", lambda e: e != 0.0), F.lit(False))
    )
    rows = vectors.select(F.col(id_col).alias("vec"), F.col(label_col).alias("label"), x.alias("v"))
    sums = rows.where(sound).groupBy("label", "v").agg(F.min("vec").alias("id"), F.count("*").alias("size"))
    # a repeated id may stand for several vectors; the class number keeps them apart
    classes = materialize(sums.select(F.coalesce("id", F.lit(-1)).alias("least"), F.xxhash64("label", "v").alias("id"), "label", "v", "size"))
    hashed = mapped(classes.select("id", "v"), _hashed, "id long, length int, keys array<long>")
    entered = materialize(hashed.join(classes, "id").select("id", "label", "length", "size", "v", "keys"))
    at = entered.select("*", F.posexplode("keys").alias("p", "key")).withColumn("tab", (F.col("p") / PROBES).cast("int")).drop("p")
    spot = ["label", "length", "tab", "key"]
    full = at.groupBy(*spot).agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("lo"), F.greatest("part", o).alias("hi")))
    placed = (
        at.join(full, spot)
        .withColumn("part", part)
        .select("id", "label", "length", "size", "v", "keys", "tab", "key", "part", "parts", F.explode(pairs).alias("block"))
        .select("*", "block.lo", "block.hi")
        .drop("block")
    )
    groups = max(1, (entered.count() * TABLES) // ROWS_TOGETHER)
    home = F.when(F.col("parts") == 1, F.pmod(F.xxhash64(*spot), F.lit(groups))).otherwise(F.xxhash64(*spot, "lo", "hi"))
    found = materialize(
        placed.withColumn("home", home).drop("parts").groupBy("home")
        .applyInPandas(lambda rows: _verify(rows, threshold), "id long, links long, low long")
    )
    merged = connected_components(found.select(F.col("id").alias("u"), F.col("low").alias("v")))
    linked = (
        classes.select("id", "label", "v", "size", "least")
        .join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
        .join(merged.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("label", "v", "component_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    good = rows.where(sound).join(named, ["label", "v"]).select("vec", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    return good.unionByName(alone).select(
        F.col("vec").alias(id_col), "n_links", "component_id", F.col("vec").eqNullSafe(F.col("component_id")).alias("kept")
    )
