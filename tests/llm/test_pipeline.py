import hashlib
from collections import Counter

import public_tokenizers
from test_parity_join import brute
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.mixing import mix
from tessera.llm.pii_surrogates import attempts_for, rewrite
from tessera.llm.quality_pairs import features, train
from tessera.sources import read_table

DATA = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    """Each stage again by plain loops: the fitted scores, all pairs, the rewriter, the counted copies, the library."""
    import numpy as np

    docs = read_table(spark, DATA, "documents")
    model = train(docs, read_table(spark, DATA, "labels"))
    rows = [r for r in docs.collect() if model.score(np.array([features(r.text or "")]))[0] >= 0.3]
    component = {i: c if n else i for i, n, c in brute([(r.doc_id, r.text) for r in rows], 5, 80, 100)}
    rows = [r for r in rows if component[r.doc_id] == r.doc_id]
    spark.conf.set("spark.tessera.pii.key", "a key")
    kept = spark.createDataFrame([(r.text,) for r in rows], "text string")
    found = attempts_for(kept, b"a key")
    moved = {(r.kind, r.canonical): (r.as_kind, r.attempt) for r in found.collect()} if found is not None else {}
    texts = {r.doc_id: rewrite(r.text, b"a key", moved)[0] for r in rows}
    kept = spark.createDataFrame([(r.doc_id, texts[r.doc_id], r.source) for r in rows], "doc_id long, text string, source string")
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in mix(kept).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest()] += r.copies
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == +want


def test_stages_keep_the_columns(spark):
    docs = read_table(spark, DATA, "documents")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_edges(spark, tmp_path):
    """Empty tables, nulls in every column, empty and long texts, repeated rows, and columns named like the stages' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kinds string, score double, size long, copies long, n_entities long"
    extra = ("k", 0.5, 7, 8, 9)
    rows = [(1, "Mrs. Alice Smith mailed a@b.org " * 3, "en", "web", 96), (2, None, None, None, None), (None, "some text here that is fine", None, "web", 27), (3, "", "en", "books", 0), (1, "Mrs. Alice Smith mailed a@b.org " * 3, "en", "web", 96), (4, "word " * 60_000, "en", "web", 300_000)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for n, some in enumerate((rows, [])):
        folder = str(tmp_path / str(n))
        spark.createDataFrame([(*r, *extra) for r in some], schema).write.parquet(f"{folder}/documents.parquet")
        labels.where("doc_id is not null" if some else "false").write.parquet(f"{folder}/labels.parquet")
        docs = read_table(spark, folder, "documents")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")], name
        texts = [r.text or "" for r in docs.collect()]
        assert not any("Alice" in t or "a@b.org" in t for t in texts)
        out = corpus_pipeline.run(spark, folder).collect()
        assert (len(out) > 0) == bool(some) and all(r.n_tokens is not None for r in out)
        assert {r.kinds for r in docs.collect()} <= {"k"}
