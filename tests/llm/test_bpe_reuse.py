import hashlib

import public_tokenizers
from test_token_counts import cases
from tokenizers import Tokenizer

from tessera.llm import bpe_reuse
from tessera.llm.bpe_reuse import Codec, cut_points, encode_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_joins_equal_the_library_wherever_chunks_are_cut(monkeypatch):
    library = Tokenizer.from_file(PATH)
    plain = cut_points
    for bits, least in ((11, 256), (3, 4), (1, 1)):
        monkeypatch.setattr(bpe_reuse, "cut_points", lambda data, b=0, bits=bits, least=least: plain(data, bits, least))
        codec = Codec(PATH)
        for text in cases(200):
            want = library.encode(text, add_special_tokens=False).ids
            assert codec.encode(text, 11) == want, repr(text)
            assert codec.decode(want).decode() == library.decode(want, skip_special_tokens=False)


def test_shared_passages_are_cut_alike():
    import random

    rng = random.Random(9)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)).encode()
    pieces = lambda d: {d[a:b] for a, b in zip([0, *cut_points(d)], cut_points(d), strict=False)}
    a, b = pieces(b"one start " + passage), pieces(b"quite another beginning " * 40 + passage)
    assert len(a & b) > 0.7 * len(a)


def test_table_with_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (2, "", 7), (1, "a b", 5)], "doc_id long, text string, ids int")
    rows = encode_decode(docs, PATH, with_ids=True).collect()
    ids = Tokenizer.from_file(PATH).encode("a b").ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted([(1, 2, digest(",".join(map(str, ids))), digest("a b"))] * 2 + [(2, 0, digest(""), digest(""))] * 2)
    assert {(tuple(r.ids), r.decoded) for r in rows} == {(tuple(ids), "a b"), ((), "")}
    assert encode_decode(docs.limit(0), PATH).collect() == []


def test_common_chunks_are_encoded_once_and_results_stay(spark):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh é中") for _ in range(6))
    passage = " ".join(word() for _ in range(4000))
    rows = [(i, " ".join(word() for _ in range(50)) + passage + word()) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    library = Tokenizer.from_file(PATH)
    for size in (48 << 20, 12_000, 0):
        found = encode_decode(docs, PATH, with_ids=True, dictionary_bytes=size, with_reuse=True).collect()
        assert {r.doc_id: r.ids for r in found} == {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
        shared, chunks = sum(r.from_dictionary for r in found), sum(r.chunks for r in found)
        assert (shared > 0.8 * chunks) if size > 1e6 else (shared <= 24)


def test_a_table_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(PATH)
    want = {r.doc_id: hashlib.sha256(",".join(map(str, library.encode(r.text or "", add_special_tokens=False).ids)).encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.ids_sha256 for r in encode_decode(docs, PATH).collect()} == want
    assert max(r.n_chars for r in docs.collect()) > 10_000
