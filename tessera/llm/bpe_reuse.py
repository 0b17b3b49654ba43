"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of the last 32 bytes has ``bits`` zero bits, so passages shared by
documents yield the same chunks wherever they stand. Chunks are named by 128-bit hashes. Names are counted over
the corpus; the chunks that are in it most often, as many as fit into ``dictionary_bytes``, are encoded once, and
that dictionary goes to all tasks. A chunk that is shared less often is encoded once for each Python worker while it stays in
the worker's bounded cache: sharing those across workers, too, would take a table of all chunks and a shuffle of
all texts and ids, which costs more disk than encoding them again. Neither bound changes any result.

Chunk edges fall anywhere; so each join is repaired: the text from the last stable boundary before it to the first one
after it is encoded again, and if either side has none, the window widens over more chunks until it has. A boundary
is stable where a non-space character is followed by a space: no pre-token of the byte-level pattern
holds a space after a non-space, its look-ahead only looks at what follows white space, and no special
token holds a space, so encodings on both sides are independent and the result is exactly the library's.

Null text: empty. Empty texts have no ids. Repeated rows are given as often as they come; extra columns
are not read; an empty table gives an empty table. Very long texts are one row of one batch.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .token_counts import LATIN_LETTERS, LATIN_NUMBERS, WHITE, is_latin

#: Runs that begin at a stable boundary: optional white space, then non-space; or white space alone.
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The byte-level pattern for characters up to U+00FF: a finer cut, of which fewer are distinct.
LATIN_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+| ?[^{WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
STABLE = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")

_GEAR = np.random.default_rng(20_240_229).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: bytes, bits: int = 11, least: int = 256) -> list[int]:
    """Ends of the content-defined chunks of UTF-8 ``data``; the last is its length. Chunks average 2**bits bytes."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):  # after k rounds h covers the last 2**k bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    hits = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    out, last = [], 0
    for at in hits.tolist():
        while at < n and (raw[at] & 0xC0) == 0x80:  # never inside a character
            at += 1
        if at - last >= least and at < n:
            out.append(at)
            last = at
    out.append(n)
    return out


def chunks_of(text: str, bits: int) -> Iterator[str]:
    data = text.encode()
    for low, high in pairwise([0, *cut_points(data, bits)]):
        yield data[low:high].decode()


Chunk = tuple[int, int, tuple[int, ...]]  # end of the head, start of the tail, ids between them; both 0 without a stable boundary


class Codec:
    """Encodes and decodes with a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str, cache_pieces: int = 600_000, cache_chunk_bytes: int = 32 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        form = json.loads(self.tokenizer.to_str())
        pre = form["pre_tokenizer"] or {}
        self.latin = form["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and all("<|" in t for t in self.special)
        visible = self._byte_alphabet()
        self.digits = [str(i) for i in range(size)]
        self.bytes = [self._token_bytes(self.tokenizer.id_to_token(i) or "", visible) for i in range(size)]
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[bytes, Chunk] = {}
        self.shared: dict[bytes, Chunk] = {}
        self.looked_up = self.found_shared = self.found_own = 0
        self.chunk_bytes, self.cache_pieces, self.cache_chunk_bytes = 0, cache_pieces, cache_chunk_bytes

    @staticmethod
    def _byte_alphabet() -> dict[str, int]:
        """Byte-level BPE writes each byte as a printable character: itself, or the next free one from U+0100."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        out, free = {chr(b): b for b in plain}, 256
        for b in range(256):
            if b not in plain:
                out[chr(free)] = b
                free += 1
        return out

    def _token_bytes(self, token: str, visible: dict[str, int]) -> bytes:
        return token.encode() if token in self.special else b"".join(bytes([visible[c]]) if c in visible else c.encode() for c in token)

    def encode_stable(self, text: str) -> list[int]:
        """Ids of a text that begins and ends at a stable boundary, piece by piece from the cache."""
        fine = self.latin and "<|" not in text and is_latin(text)
        pieces, cache = (LATIN_PIECE if fine else PIECE).findall(text), self.pieces
        try:
            return list(chain.from_iterable(map(cache.__getitem__, pieces)))
        except KeyError:
            missing = list({p for p in pieces if p not in cache})
        if len(cache) + len(missing) > self.cache_pieces:
            cache.clear()
            missing = list(set(pieces))
        extra: dict[str, tuple[int, ...]] = {}
        for p, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            (cache if len(p) <= 64 else extra)[p] = tuple(e.ids)
        return list(chain.from_iterable(cache[p] if p in cache else extra[p] for p in pieces))

    def fresh(self, text: str) -> Chunk:
        """A chunk, encoded between its first and last stable boundary."""
        first = STABLE.search(text)
        if first is None:
            return (0, 0, ())
        head = tail = first.start()
        for m in STABLE.finditer(text, max(head, len(text) - 512)):
            tail = m.start()
        if tail == head:
            for m in STABLE.finditer(text, head):
                tail = m.start()
        return (head, tail, tuple(self.encode_stable(text[head:tail])))

    def chunk(self, text: str) -> Chunk:
        """A chunk from the dictionary, the worker's cache, or encoded now."""
        key = xxhash.xxh3_128_digest(text.encode())
        self.looked_up += 1
        if (found := self.shared.get(key)) is not None:
            self.found_shared += 1
            return found
        if (found := self.chunks.get(key)) is not None:
            self.found_own += 1
            return found
        found = self.fresh(text)
        cost = 200 + 8 * len(found[2])
        if self.chunk_bytes + cost > self.cache_chunk_bytes:
            self.chunks.clear()
            self.chunk_bytes = 0
        self.chunks[key] = found
        self.chunk_bytes += cost
        return found

    def encode(self, text: str, bits: int = 11) -> list[int]:
        ids: list[int] = []
        open_text = ""
        for part in chunks_of(text, bits):
            head, tail, middle = self.chunk(part)
            if head == 0:
                open_text += part  # no stable boundary: the window widens over the next chunk
                continue
            ids += self.encode_stable(open_text + part[:head])
            ids += middle
            open_text = part[tail:]
        if open_text:
            ids += self.encode_stable(open_text)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text; bytes that aren't UTF-8 become U+FFFD, as in the library."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return out.decode(errors="replace").encode()

    def listing(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec_for(path: str) -> Codec:
    """The Python worker's codec, which keeps its caches from task to task."""
    return Codec(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def common_chunks(docs: DataFrame, bits: int, dictionary_bytes: int) -> DataFrame:
    """(key, n, size) of the chunks that occur most often, at least twice, as many as fit into ``dictionary_bytes``.

    Names alone are counted, after counting them within each batch.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for text in batch.column(0).to_pylist():
                for part in chunks_of(text or "", bits):
                    raw = part.encode()
                    seen.setdefault(xxhash.xxh3_128_digest(raw), [0, len(raw)])[0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([b for _, b in seen.values()], pa.int64())], names=["key", "n", "size"])

    counts = docs.select("text").mapInArrow(names, "key binary, n long, size long").groupBy("key").agg(F.sum("n").alias("n"), F.max("size").alias("size")).where("n > 1")
    most = dictionary_bytes // DICTIONARY_ROW
    return counts.orderBy(F.desc("n"), "key").limit(most)


#: Bytes that a chunk of the dictionary takes on average, in each Python worker: about 500 ids and a name.
DICTIONARY_ROW = 6_000


def dictionary(docs: DataFrame, tokenizer_path: str, bits: int = 11, dictionary_bytes: int = 48 << 20) -> dict[bytes, Chunk]:
    """The most common chunks of the corpus, each encoded once, in Spark."""
    wanted = {bytes(r["key"]) for r in common_chunks(docs, bits, dictionary_bytes).collect()}  # bounded by dictionary_bytes
    if not wanted:
        return {}
    asked = docs.sparkSession.sparkContext.broadcast(wanted)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            found: dict[bytes, str] = {}
            for text in batch.column(0).to_pylist():
                for part in chunks_of(text or "", bits):
                    key = xxhash.xxh3_128_digest(part.encode())
                    if key in asked.value and key not in sent:
                        found[key] = part
                        sent.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.string())], names=["key", "text"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(tokenizer_path)
        for batch in batches:
            made = [codec.fresh(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int32()), pa.array([list(m[2]) for m in made], pa.list_(pa.int32()))], names=["key", "head", "tail", "ids"])

    one = docs.select("text").mapInArrow(texts, "key binary, text string").dropDuplicates(["key"])
    rows = one.mapInArrow(encoded, "key binary, head int, tail int, ids array<int>").collect()  # bounded by dictionary_bytes
    return {bytes(r["key"]): (r["head"], r["tail"], tuple(r["ids"])) for r in rows}


def encode_decode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, bits: int = 11, dictionary_bytes: int = 48 << 20, with_reuse: bool = False) -> DataFrame:
    """Encodes each row's text, decodes the ids, and returns both digests; ``with_ids`` adds ``ids`` and ``decoded``.

    ``with_reuse`` adds, for measuring, how many chunks the row has and how many came from the dictionary and from the
    worker's cache. ``dictionary_bytes`` 0 makes no dictionary.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, tokenizer_path, bits, dictionary_bytes) if dictionary_bytes else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(tokenizer_path)
        codec.shared = shared.value
        for batch in batches:
            n, ids_hash, text_hash, all_ids, decoded, reuse = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                before = (codec.looked_up, codec.found_shared, codec.found_own)
                ids = codec.encode(text or "", bits)
                back = codec.decode(ids)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(codec.listing(ids).encode()).hexdigest())
                text_hash.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    decoded.append(back.decode())
                if with_reuse:
                    reuse.append([b - a for a, b in zip(before, (codec.looked_up, codec.found_shared, codec.found_own), strict=True)])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            if with_reuse:
                columns += [pa.array([r[i] for r in reuse], pa.int64()) for i in range(3)]
                names += ["chunks", "from_dictionary", "from_cache"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = SCHEMA + ", ids array<int>, decoded string" * with_ids + ", chunks long, from_dictionary long, from_cache long" * with_reuse
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
