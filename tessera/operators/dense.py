"""Exact vector search: blocks of the store meet blocks of the queries as matrix products in Arrow batches.

Each block puts out its own k best a query, so what is shuffled is k rows for a query and a block, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, doubles, unit

#: Queries of a block; one block (at 1,024 dimensions 40 MB) travels to all tasks, more are dealt out with the store's blocks.
BROADCAST_QUERIES = 5_000
#: Vectors of a block where there are several blocks of queries.
BLOCK_ROWS = 8_192
#: Scores that a task holds at once, and texts that it embeds at once.
SCORES_HELD = 1_000_000
TEXTS_HELD = 256
#: Words whose hashes a worker keeps.
HASHED_WORDS = 50_000


def store(vectors: DataFrame, normalize: bool = True, dims: int | None = None) -> DataFrame:
    """(id string, vec array<double>, meta map) from (id, vec[, meta]); unit vectors if ``normalize``.

    Appending to a store is ``unionByName``. A vector of other than ``dims`` numbers is an error.
    """
    vec = doubles("vec")
    if dims is not None:
        vec = F.when(F.size(vec) == dims, vec).otherwise(F.raise_error(F.lit(f"vector does not have {dims} dimensions")).cast("array<double>"))
    meta = F.col("meta") if "meta" in vectors.columns else F.create_map().cast("map<string,string>")
    return vectors.select(F.col("id").cast("string").alias("id"), (unit(vec) if normalize else vec).alias("vec"), meta.alias("meta"))


def embed_texts(texts: DataFrame, embed: Callable[[str], np.ndarray]) -> DataFrame:
    """``texts`` with ``vec`` from a Python embedder, by Arrow batches of which few texts at a time become Python objects."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(column), TEXTS_HELD):
            found = [np.asarray(embed(t or ""), float) for t in column.slice(at, TEXTS_HELD).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return texts.withColumn("vec", run("text"))


def hashed_embedder(dims: int = 64) -> Callable[[str], np.ndarray]:
    """A deterministic bag-of-words embedder: words are hashed to signed dimensions, then scaled to unit length.

    A word's hash is the number of the first 8 hexadecimal digits of the MD5 of its lower case; the highest bit gives the sign.
    """
    import hashlib
    import re

    known: dict[str, int] = {}

    def embed(text: str) -> np.ndarray:
        out = np.zeros(dims)
        for word in re.findall(r"\w+", text):
            h = known.get(word)
            if h is None:
                if len(known) >= HASHED_WORDS:
                    known.clear()
                h = known[word] = int(hashlib.md5(word.lower().encode()).hexdigest()[:8], 16)
            out[h % dims] += 1.0 if h >> 31 else -1.0
        return out / max(float(np.linalg.norm(out)), 1e-9)

    return embed


def scores(vectors: DataFrame, queries: DataFrame, normalize: bool = True) -> DataFrame:
    """(query_id, id, score) of all pairs of (id, vec) and a stated query set (query_id, qvec)."""
    q = queries.select("query_id", (unit(doubles("qvec")) if normalize else doubles("qvec")).alias("qvec"))
    small = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    pairs = vectors.crossJoin(F.broadcast(q) if small else q)
    return pairs.select("query_id", "id", dot(F.col("vec"), F.col("qvec")).alias("score"))


def top_k(scored: DataFrame, k: int, tie: str = "id", digits: int = 9) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query; equal scores by ``tie``."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", digits).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best_of_block(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of each query, by the order of ``top_k``; all equals of the k-th are kept.

    Queries are taken a few at a time, so the scores held do not grow with their number.
    """
    step = max(1, SCORES_HELD // max(1, len(ids)))
    parts = []
    for first in range(0, len(queries), step):
        score = queries[first : first + step] @ vectors.T
        if k < len(ids):
            rounded = np.round(score, digits)
            least = np.partition(rounded, len(ids) - k, axis=1)[:, len(ids) - k]
            q, v = np.nonzero(rounded >= least[:, None] - 1e-12)
        else:
            q, v = np.nonzero(np.ones_like(score, bool))
        parts.append((q + first, v, score[q, v]))
    q, v, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    return q, ids[v], score


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, normalize: bool = True, digits: int = 9) -> DataFrame:
    """(query_id, rank, id, score): the k best vectors (id, vec) for each query (query_id, qvec); equal scores by id."""
    q = queries.select("query_id", (unit(doubles("qvec")) if normalize else doubles("qvec")).alias("qvec"))
    v = vectors.select("id", "vec")  # null vectors go in the function: a filter here would run an embedder in the plan twice
    kind = dict(q.dtypes)["query_id"]
    schema = f"query_id {kind}, id string, score double"
    if k <= 0:
        return v.sparkSession.createDataFrame([], f"query_id {kind}, rank int, id string, score double")
    few = q.limit(BROADCAST_QUERIES + 1).collect()  # at most one block and a row
    if len(few) <= BROADCAST_QUERIES:
        few = [r for r in few if r["qvec"] is not None]
        names, matrix = [r["query_id"] for r in few], np.array([r["qvec"] for r in few], float)

        def against_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b = b[b["vec"].notna()]
                if len(b) and names:
                    at, ids, score = _best_of_block(b["id"].to_numpy(), np.stack(b["vec"]), matrix, k, digits)
                    yield pd.DataFrame({"query_id": [names[i] for i in at], "id": ids, "score": score})

        found = v.mapInPandas(against_all, schema)
    else:
        q, v = q.where("qvec is not null"), v.where("vec is not null")
        n_queries = -(-q.count() // BROADCAST_QUERIES)
        n_vectors = max(1, -(-v.count() // BLOCK_ROWS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = v.select(F.pmod(F.xxhash64("id"), F.lit(n_vectors)).alias("vb"), every(n_queries).alias("qb"), "id", "vec")
        right = q.select(every(n_vectors).alias("vb"), F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).cast("int").alias("qb"), "query_id", "qvec")

        def block(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return pd.DataFrame({"query_id": y["query_id"].iloc[:0], "id": [], "score": np.empty(0)})
            at, ids, score = _best_of_block(x["id"].to_numpy(), np.stack(x["vec"]), np.stack(y["qvec"]), k, digits)
            return pd.DataFrame({"query_id": y["query_id"].to_numpy()[at], "id": ids, "score": score})

        on = [F.col("vb").cast("int"), F.col("qb").cast("int")]
        found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(block, schema)
    return top_k(found, k, digits=digits).select("query_id", "rank", "id", "score")


def search_text(vectors: DataFrame, queries: DataFrame, embed: Callable[[str], np.ndarray], k: int = 5) -> DataFrame:
    return search(vectors, embed_texts(queries, embed).select("query_id", F.col("vec").alias("qvec")), k)
