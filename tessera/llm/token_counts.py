"""Token counts by overlap resynchronisation.

A document is encoded with a library tokenizer (a ``tokenizers`` JSON file). Documents longer than ``chunk_chars`` are
cut into chunks that overlap; every chunk is encoded with the library's offsets, and two neighbours are spliced at a
token boundary inside their overlap that both encodings have and that is proven stable, in two ways. First, it is the
start of a run of non-space characters after a space: the vocabularies meant here drop or separate white space
before any merge is made, their normalizers work on one character or on a base with its marks (and white space is
neither), and no special token holds white space, so an encoding never depends on what stands across such a
boundary. Second, both encodings give the same tokens at the same offsets from there to the last such boundary in the
overlap. Where there is no such boundary, or the two disagree, the overlap is widened, at last to the document's
start and end, and then the two chunks become one.

A document of one chunk has no overlap; its pieces (by such boundaries, and for plain Latin text by the vocabulary's
own pattern) are encoded by the library once while they stay in a bounded cache, since prose repeats them.

Null and empty texts have 0 tokens. Repeated rows are given as often as they come. Extra columns are
not read. An empty table gives an empty table. Very long texts are never encoded at once, unless nothing splits them.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Unicode's White_Space, which the tokenizers' ``\s`` means; Python's ``\s`` has U+001C-001F besides.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
RUN = re.compile(f"[^{WHITE}]+")
#: Letters and numbers (``\\p{L}``, ``\\p{N}``) up to U+00FF, where no version of Unicode differs.
LATIN_LETTERS, LATIN_NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
#: The pattern by which the word vocabulary separates a text before merging, for characters up to U+00FF.
LATIN_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]+")


def is_latin(text: str) -> bool:
    """Whether all characters are below U+0100, so that NFC changes nothing and lower case keeps the length."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


SCHEMA = "doc_id long, n_bytes long, n_tokens long"


class Encoder:
    """The library tokenizer, without truncation, padding and special tokens of its own."""

    def __init__(self, path: str, cache_pieces: int = 1_000_000, cached_length: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.counts: dict[str, int] = {}
        self.cache_pieces, self.cached_length = cache_pieces, cached_length
        # the finer cut of plain Latin text holds for this one form of file
        form = json.loads(self.tokenizer.to_str())
        split = [p.get("pattern", {}).get("Regex") for p in (form["pre_tokenizer"] or {}).get("pretokenizers", [])]
        steps = [n["type"] for n in (form["normalizer"] or {}).get("normalizers", [])]
        self.latin = split[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"] and steps == ["NFC", "Replace", "Lowercase"]
        self.latin = self.latin and all("<|" in t["content"] and not t["normalized"] for t in form["added_tokens"])

    def whole(self, text: str) -> int:
        """Number of tokens of a text that is one chunk: the sum over its pieces, each counted once while it stays in a bounded cache."""
        plain = self.latin and "<|" not in text and is_latin(text)
        pieces, counts = LATIN_PIECE.findall(text.lower()) if plain else RUN.findall(text), self.counts
        try:
            return sum(map(counts.__getitem__, pieces))
        except KeyError:
            missing = list({p for p in pieces if p not in counts})
        if len(counts) + len(missing) > self.cache_pieces:
            counts.clear()
            missing = list(set(pieces))
        found = {p: len(e) for p, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True)}
        counts.update((p, n) for p, n in found.items() if len(p) <= self.cached_length)
        return sum(found[p] if p in found else counts[p] for p in pieces)

    def chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of text[start:end], and where in the whole text each begins."""
        found = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
        return np.array(found.ids, np.int64), at + start


@functools.lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """The Python worker's encoder."""
    return Encoder(path)


BOUNDARY = re.compile(f"(?<=[{WHITE}])[^{WHITE}]")


def splice(text: str, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], low: int, high: int) -> tuple[int, int] | None:
    """(tokens of ``left`` to keep, tokens of ``right`` to leave out) at the first stable boundary in [low, high), or None.

    ``high`` is the left chunk's end, where a run may have been cut; so the last boundary before it ends what is compared.
    """
    stable = [m.start() for m in BOUNDARY.finditer(text, max(0, low - 1), high)]
    if stable and stable[0] < low:
        stable.pop(0)
    if len(stable) < 2:
        return None
    (ids, at), (more, more_at) = left, right
    both = np.intersect1d(np.intersect1d(stable[:-1], at), more_at)  # where a token begins in both
    if not len(both):
        return None
    first, last = both[0], stable[-1]
    a, b, c, d = np.searchsorted(at, first), np.searchsorted(at, last), np.searchsorted(more_at, first), np.searchsorted(more_at, last)
    agree = b - a == d - c and (at[a:b] == more_at[c:d]).all() and (ids[a:b] == more[c:d]).all()
    return (int(a), int(c)) if agree else None


def encode_document(encoder: Encoder, text: str, chunk_chars: int, overlap_chars: int) -> Iterator[np.ndarray]:
    """Token ids of the text, part by part."""
    size = len(text)
    start, end = 0, min(chunk_chars, size)
    left = encoder.chunk(text, start, end)
    while end < size:
        overlap = overlap_chars
        while True:
            begin = max(start, end - overlap)
            right_end = min(size, begin + chunk_chars + overlap)
            right = encoder.chunk(text, begin, right_end)
            if (at := splice(text, left, right, begin, end)) is not None:
                yield left[0][: at[0]]
                left, start, end = (right[0][at[1] :], right[1][at[1] :]), int(right[1][at[1]]), right_end
                break
            if begin == start:  # nothing splits the left chunk: it grows to the right
                end = min(size, end + max(chunk_chars, end - start))
                left = encoder.chunk(text, start, end)
                break
            overlap *= 4
    yield left[0]


def token_counts(docs: DataFrame, tokenizer_path: str, chunk_chars: int = 16_384, overlap_chars: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs`` (doc_id, text). No shuffle.

    ``tokenizer_path`` must exist on every executor, as the library's package data does.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [encoder.whole(t) if len(t) <= chunk_chars else sum(map(len, encode_document(encoder, t, chunk_chars, overlap_chars))) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
