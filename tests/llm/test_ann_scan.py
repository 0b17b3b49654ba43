import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann_scan
from tessera.llm.ann_scan import nearest, scan
from tessera.sources import read_table


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if i != q][:k]
    return [(int(ids[i]), d[i]) for i in order]


def test_recall_against_brute_force(spark):
    table = read_table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in nearest(table, F.col("vec_id") % 100 == 0, part_rows=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = []
    for q in np.flatnonzero(ids % 100 == 0):
        want, mine = brute(ids, x, q), sorted(got[int(ids[q])])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((x[q] - x[v]) ** 2).sum())) < 1e-12 for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hit.append(len({v for v, _ in want} & {v for _, v, _ in mine}) / 10)
    assert np.mean(hit) >= 0.9


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64)) @ np.diag(np.linspace(2, 0.1, 64)) @ np.linalg.qr(rng.normal(size=(64, 64)))[0]
    kept = []
    for q in x[:50]:
        d = ((x - q) ** 2).sum(1)
        kept.append(np.isin(np.argsort(d)[:10], scan(q, x, 10, 16, 2.1)).mean())
    assert np.mean(kept) > 0.99


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (100, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (200, [0.0, 0.0]), (1, [0.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, list string")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest(table, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100), (0, 2, 1), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert nearest(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_outlying_queries_get_k_rows(spark, monkeypatch):
    """Lists of one or a few vectors: with one list a query would get fewer than ten rows."""
    monkeypatch.setattr(ann_scan, "lists_to_scan", lambda *_: 1)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(390, 8)), 1000 * np.eye(8), -1000 * np.eye(8)[:2]])
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(docs, F.col("vec_id") >= 390).groupBy("query_id").count().collect()
    assert sorted((r["query_id"], r["count"]) for r in got) == [(i, 10) for i in range(390, 400)]
