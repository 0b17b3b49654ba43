import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.token_counts import Encoder, encode_document, splice, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab  \n\t\x1c\x1f\x85\xa0 　'sÉé́中文<|endoftext|>1.,!\r\x0b\U0001F600ķᅡ"


def cases(n=400):
    rng = random.Random(4)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>", " <|endoftext|> x"]) for _ in range(n)]
    return [*made, "", " ", "a" * 3000 + " " + "b" * 3000, "x" * 5000, "中" * 2000 + " é" * 900, "don't we'll THE the"]


@pytest.mark.parametrize(("chunk", "overlap"), [(8_192, 256), (40, 6), (7, 2)])
def test_spliced_chunks_equal_the_library(chunk, overlap):
    library, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    for text in cases():
        want = library.encode(text, add_special_tokens=False).ids
        assert np.concatenate([*encode_document(encoder, text, chunk, overlap)]).tolist() == want, repr(text)
        assert encoder.whole(text) == len(want), repr(text)


def test_overlaps_that_disagree_are_widened():
    encoder = Encoder(PATH)
    text = "one two three four five six seven"
    left, right = encoder.chunk(text, 0, 24), encoder.chunk(text, 6, 33)
    assert splice(text, left, right, 6, 24) == (2, 1)  # "o" of "two" is cut off, so "three" is the first
    wrong = (right[0] + (right[1] == 14), right[1])  # another token for "four"
    assert splice(text, left, wrong, 6, 24) is None
    assert splice("x" * 40, encoder.chunk("x" * 40, 0, 30), encoder.chunk("x" * 40, 10, 40), 10, 30) is None


def test_a_table_of_documents_that_cross_chunk_ends(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    library = Tokenizer.from_file(PATH)
    rows = docs.collect()
    assert sum(len(r.text or "") > 512 for r in rows) > 100
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH, 512, 64).collect()} == want
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()} == want


def test_table_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "the cat sat", "x"), (2, None, "y"), (3, "", None), (1, "the cat sat", "x"), (None, "word " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(docs, PATH).collect()), key=repr)
    assert got == sorted([(1, 11, 3), (2, 0, 0), (3, 0, 0), (1, 11, 3), (None, 150_000, 30_000)], key=repr)
    assert token_counts(docs.limit(0), PATH).collect() == []
