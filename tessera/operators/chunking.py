"""Chunks of texts by words, sentences or token ids; one row per chunk."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SENTENCE_END, bind, split_words, strip


def _windows(items: Column, size: int, overlap: int, stop_at_end: bool) -> Column:
    """Arrays of consecutive windows; ``stop_at_end`` drops those after one that reaches the end."""
    step = max(1, size - overlap)

    def cut(items: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(step))
        if stop_at_end:
            starts = F.filter(starts, lambda i: (i == 0) | (i - step + size < F.size(items)))
        return F.when(F.size(items) > 0, F.transform(starts, lambda i: F.slice(items, i + 1, size)))

    return bind(items, cut)


def word_chunks(docs: DataFrame, max_words: int = 200, overlap: int = 20) -> DataFrame:
    """(doc_id, chunk_id, text): windows of words joined by one space; the last may lie inside the one before."""
    windows = _windows(split_words("text"), max_words, overlap, False)
    return docs.select("doc_id", F.posexplode(windows).alias("chunk_id", "words")).select("doc_id", "chunk_id", F.array_join("words", " ").alias("text"))


def pack_sentences(parts: list[str], max_chars: int, overlap: int) -> list[str]:
    """Sentences appended while they fit; a full chunk hands its last ``overlap`` characters on."""
    chunks: list[str] = []
    open_chunk = ""
    for part in parts:
        if not open_chunk:
            open_chunk = part.strip()
        elif len(open_chunk) + 1 + len(part) <= max_chars:
            open_chunk = f"{open_chunk} {part.strip()}"
        else:
            chunks.append(open_chunk)
            tail = open_chunk[-overlap:] if overlap > 0 else ""
            open_chunk = f"{tail} {part.strip()}".strip()
    return [*chunks, open_chunk] if open_chunk else chunks


def sentence_chunks(docs: DataFrame, max_chars: int = 1000, overlap: int = 100) -> DataFrame:
    """(doc_id, chunk_id, text). The fold over sentences is sequential, so it runs in Arrow batches."""

    @F.pandas_udf("array<string>")
    def pack(parts: pd.Series) -> pd.Series:
        return pd.Series([pack_sentences(list(p), max_chars, overlap) if p is not None else [] for p in parts])

    parts = F.split(strip("text"), SENTENCE_END)
    return docs.select("doc_id", F.posexplode(pack(parts)).alias("chunk_id", "text"))


def token_chunks(encoded: DataFrame, decode, max_tokens: int = 256, overlap: int = 32) -> DataFrame:
    """(doc_id, chunk_id, text) from (doc_id, ids); ``decode`` maps a column of ids to text."""
    windows = _windows(F.col("ids"), max_tokens, overlap, True)
    cut = encoded.select("doc_id", F.posexplode(windows).alias("chunk_id", "ids"))
    return cut.select("doc_id", "chunk_id", decode(F.col("ids")).alias("text"))


