"""Approximate nearest neighbours by inverted lists and an adaptive scan of dimensions.

Vectors are rotated by a random orthogonal matrix and dealt to lists by their nearest centroid. A query
scans the lists whose centroids are nearest. In a list, distances grow by blocks of columns; after each
block a candidate is given up when a hypothesis test on the part seen so far says that its whole distance is
beyond the query's current k-th best (the rotation makes a part of d columns an estimate with relative
error about ``epsilon / sqrt(d)``). Survivors get their exact distance on the original vectors in double
precision; ties go to the smaller id.

Rotation and centroids are fitted on at most ``max_sample`` vectors (those with the smallest hash of their
id), and all vectors are indexed; there are as many lists as the square root of all vectors, but at most one for
every eight of the sample. The number of lists to scan is the smallest whose recall on that sample, against brute
force, reaches ``target_recall``; then whole searches of the sample, tests included, are measured, and ``epsilon``
grows until they reach MEASURED_RECALL. A query whose lists hold few vectors scans further ones. Lists are split into parts
of about ``part_rows`` vectors, and the queries of a list into groups of about ``part_rows``, so no task holds
a whole hot list. Pairs of query and list travel as numbers; vectors join them once, in the element type of the table.

Vectors that are null, zero, hold null or non-finite components, have a null id, or a length other than
the most common one take no part. Of rows with one id the smallest vector counts. With fewer than k
candidates all are returned. Very long vectors are rows like others. Extra columns are not read; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, hashed_sample, materialize

RESULT = "query_id long, vec_id long, score double"
#: The lists that a query scans hold at least this many times the vectors that it asks for.
SPARE = 4
#: Recall that whole searches of the sample must reach.
MEASURED_RECALL = 0.97


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part; v are doubles, or floats where the table has those."""
    kind = dict(vectors.dtypes)["embedding"]
    v = F.col("embedding").cast("array<float>" if kind == "array<float>" else "array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    clean = clean.where(~F.exists("v", bad)).where(F.exists("v", lambda x: x != 0))
    return clean.groupBy("vec_id").agg(F.min("v").alias("v"))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of the sample; an emptied one is put on the point farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1)[None] - 2 * x @ c.T
        own = d.argmin(1)
        count = np.bincount(own, minlength=k)
        c = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1) / np.maximum(count, 1)[:, None]
        if (empty := np.flatnonzero(count == 0)).size:
            far = np.argsort(-(d[np.arange(len(x)), own] + (x * x).sum(1)))[: empty.size]
            c[empty] = x[far]
    return c


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def lists_to_scan(x: np.ndarray, centroids: np.ndarray, k: int, target_recall: float, queries: int = 256) -> int:
    """The fewest lists that reach the recall on the sample, with a tenth and one more for safety."""
    q = x[np.random.default_rng(3).choice(len(x), min(queries, len(x)), replace=False)]
    near = np.argsort(squared(q, x), axis=1)[:, : k + 1]  # the query itself is among them
    own = squared(x, centroids).argmin(1)
    order = np.argsort(np.argsort(squared(q, centroids), axis=1), axis=1)  # rank of each list for each query
    rank = np.take_along_axis(order, own[near], axis=1)
    for n in range(1, len(centroids) + 1):
        if (rank < n).mean() >= target_recall:
            return min(len(centroids), n + 1 + n // 10)
    return len(centroids)


def lists_of(order: np.ndarray, sizes: np.ndarray, n_scan: int, enough: int) -> list[np.ndarray]:
    """Of each query's lists, nearest first, the first ``n_scan`` and further ones until they hold ``enough`` vectors, or all."""
    held = np.cumsum(sizes[order], axis=1)
    return [o[: max(n_scan, int(np.searchsorted(h, enough)) + 1)] for o, h in zip(order, held, strict=True)]


def scan(query: np.ndarray, rows: np.ndarray, k: int, step: int, epsilon: float, batch: int = 512) -> np.ndarray:
    """Indexes of candidates that may be among the k nearest in one list part; all columns rotated."""
    dims = rows.shape[1]
    best = np.empty(0)
    kept: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    bound = np.inf
    for at in range(0, len(rows), batch):
        alive = np.arange(at, min(at + batch, len(rows)))
        partial = np.zeros(len(alive))
        for low in range(0, dims, step):
            high = min(dims, low + step)
            d = rows[alive, low:high] - query[low:high]
            partial += np.einsum("ij,ij->i", d, d)
            if high < dims and np.isfinite(bound):
                keep = partial <= bound * (high / dims) * (1 + epsilon / np.sqrt(high)) ** 2
                alive, partial = alive[keep], partial[keep]
                if not len(alive):
                    break
        if len(alive):
            inside = partial <= bound * (1 + 1e-9) + 1e-300
            kept.append(alive[inside])
            sums.append(partial[inside])
            best = np.sort(np.concatenate([best, partial[inside]]))[:k]
            if len(best) == k:
                bound = best[-1]
    if not kept:
        return np.empty(0, np.int64)
    index, total = np.concatenate(kept), np.concatenate(sums)
    return index[total <= bound * (1 + 1e-9) + 1e-300]


def measured_recall(x: np.ndarray, centroids: np.ndarray, k: int, n_scan: int, step: int, epsilon: float, queries: int = 48) -> float:
    """Share of the true k nearest that searches of the sample find, with the choice of lists and the tests of ``scan``."""
    own = squared(x, centroids).argmin(1)
    members = [np.flatnonzero(own == i) for i in range(len(centroids))]
    hits = []
    for q in np.random.default_rng(5).choice(len(x), min(queries, len(x)), replace=False):
        order = np.argsort(squared(x[q : q + 1], centroids)[0], kind="stable")[:n_scan]
        found = np.concatenate([members[i][scan(x[q], x[members[i]], k + 1, step, epsilon)] for i in order if len(members[i])])
        distance = ((x - x[q]) ** 2).sum(1)
        best = found[np.argsort(distance[found], kind="stable")[: k + 1]]
        hits.append((distance[best] <= np.sort(distance)[: k + 1][-1] * (1 + 1e-9)).sum() / min(k + 1, len(x)))
    return float(np.mean(hits))


def nearest(vectors: DataFrame, is_query, k: int = 10, max_sample: int = 16_384, target_recall: float = 0.985, part_rows: int = 2_048, step: int = 16, epsilon: float = 2.1) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest other vectors; ``is_query`` is a column over vec_id."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    clean = materialize(usable(vectors), "vectors")
    sizes = clean.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = int(sizes["dims"]), int(sizes["count"])
    kind = np.dtype(np.float32 if dict(clean.dtypes)["v"] == "array<float>" else np.float64)
    clean = clean.where(F.size("v") == dims)
    sample = hashed_sample(clean, "vec_id", max_sample, total).collect()  # bounded by max_sample
    x = np.array([r["v"] for r in sample], float)
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))[0]
    x = x @ rotation
    n_lists = int(np.clip(np.sqrt(total), 1, max(1, len(x) // 8)))
    centroids = kmeans(x, n_lists)
    n_scan = lists_to_scan(x, centroids, k, target_recall)
    while epsilon < 8 and measured_recall(x, centroids, k, n_scan, step, epsilon) < MEASURED_RECALL:
        epsilon *= 1.3

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)
                own = squared(v.astype(float) @ rotation, centroids).argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array([y.tobytes() for y in v], pa.binary())], names=["vec_id", "list", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r = np.frombuffer(b"".join(b.column(1).to_pylist()), kind).reshape(b.num_rows, dims).astype(float) @ rotation
                near = lists_of(np.argsort(squared(r, centroids), axis=1, kind="stable").astype(np.int32), sizes_of, n_scan, SPARE * (k + 1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.list_(pa.int32()))], names=["query_id", "lists"])

    index = materialize(clean.select("vec_id", "v").mapInArrow(assign, "vec_id long, list int, v binary"), "index")
    sizes_of = np.zeros(len(centroids), np.int64)
    for r in index.groupBy("list").count().collect():  # one row a list, at most an eighth of the sample
        sizes_of[r["list"]] = r["count"]
    queries = index.where(is_query).select("vec_id", "v")
    asked = materialize(queries.mapInArrow(probe, "query_id long, lists array<int>").select("query_id", F.explode("lists").alias("list")), "probes")
    parts = F.ceil(F.col("rows") / part_rows).cast("int")
    counts = index.groupBy("list").agg(F.count("*").alias("rows")).select("list", parts.alias("parts"))
    groups = asked.groupBy("list").agg(F.count("*").alias("rows")).select("list", parts.alias("groups"))
    plan = F.broadcast(counts.join(groups, "list"))  # one row a list, at most an eighth of the sample
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(plan, "list").select("list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), whole("groups").alias("grp"), "vec_id", "v")
    dealt = asked.join(plan, "list").select("list", whole("parts").alias("part"), F.pmod(F.xxhash64("query_id"), "groups").cast("int").alias("grp"), "query_id")
    right = dealt.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id")

    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids, found, scores = [], [], []
        if len(candidates) and len(queries):
            candidates = candidates.sort_values("vec_id", kind="stable")
            name = candidates["vec_id"].to_numpy()
            v = np.frombuffer(b"".join(candidates["v"]), kind).reshape(-1, dims).astype(float)
            asking = np.frombuffer(b"".join(queries["qv"]), kind).reshape(-1, dims).astype(float)
            r, rotated = v @ rotation, asking @ rotation
            for q, qv, qr in zip(queries["query_id"], asking, rotated, strict=True):
                at = scan(qr, r, k + 1, step, epsilon)  # k + 1: the query itself may be here
                at = at[name[at] != q]
                d = np.sqrt(((v[at] - qv) ** 2).sum(1))
                top = np.lexsort((name[at], d))[:k]
                ids += [q] * len(top)
                found += name[at][top].tolist()
                scores += d[top].tolist()
        return pd.DataFrame({"query_id": np.array(ids, np.int64), "vec_id": np.array(found, np.int64), "score": np.array(scores, float)})

    keys = ["list", "part", "grp"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, RESULT)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
