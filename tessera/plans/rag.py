"""The retrieval pipeline as one plan: chunk, embed, retrieve, rerank, pack."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import doubles, unit
from tessera.operators import chunking, dense, packing, rerank, retrieval
from tessera.operators.tracing import Tracer
from tessera.sources.scratch import materialize


def chunk_store(docs: DataFrame, embed: Callable[[str], np.ndarray], max_chars: int = 1000, overlap: int = 100) -> DataFrame:
    """(id, doc_id, chunk_id, text, vec): sentence chunks named "doc-chunk", with unit vectors."""
    chunks = chunking.sentence_chunks(docs, max_chars, overlap).withColumn("id", F.concat_ws("-", "doc_id", "chunk_id"))
    return dense.embed_texts(chunks, embed).select("id", "doc_id", "chunk_id", "text", unit(doubles("vec")).alias("vec"))


def answer_contexts(docs: DataFrame, queries: DataFrame, embed: Callable[[str], np.ndarray], method: str = "rrf", k: int = 3, budget: int = 80, alpha: float = 0.5, tracer: Tracer | None = None) -> DataFrame:
    """(group_id, context) for queries (query_id, text): retrieved, reranked by both kinds of ranks, packed.

    Each step is written before the next one, inside its span, so that the spans tell what the steps took.
    """
    tracer = tracer or Tracer()
    with tracer.span("pipeline", method=method, k=k):
        with tracer.span("index"):
            chunks = materialize(chunk_store(docs, embed), "chunks")
        with tracer.span("retrieve"):
            asked = materialize(dense.embed_texts(queries.select("query_id", "text"), embed).withColumnRenamed("vec", "qvec"), "asked")
            found = retrieval.Retriever(method, k).attach_vectors(chunks.select("id", "vec"), embed).attach_docs(chunks.select(F.col("id").alias("doc_id"), "text")).search(queries)
            found = materialize(found, "found")
        with tracer.span("rerank"):
            loaded = found.join(chunks.select("id", "text", "vec"), "id").select("query_id", F.col("id").alias("cand_id"), F.col("rank").alias("pos"), "score", "text", "vec")
            ordered = materialize(rerank.rerank_hybrid(loaded, asked, k, alpha), "reranked")
        with tracer.span("pack"):
            texts = ordered.join(chunks.select(F.col("id").alias("cand_id"), "text"), "cand_id")
            return materialize(packing.pack(texts.select(F.col("query_id").alias("group_id"), F.col("rank").alias("pos"), "text", F.col("fused").alias("score")), budget), "contexts")
