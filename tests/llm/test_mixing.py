import random
from collections import Counter, defaultdict

from tessera.llm.mixing import emit, mix


def levels(sizes, weights=(1, 2, 3), cap=3.0):
    """Targets by filling and resharing the excess, one round at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s, v in share.items() if v > cap * sizes[s]}
        if not over:
            return {s: share.get(s, cap * sizes[s]) for s in order}
        full |= over


def corpus(n=3000, seed=3):
    rng = random.Random(seed)
    names = ["hot", "a", "b", "c", None, "tiny", "é"]
    odds = [40, 20, 15, 10, 10, 0.4, 5]
    return [(i, "w " * min(4000, int(rng.lognormvariate(4, 1))), rng.choices(names, odds)[0]) for i in range(n)]


def test_targets_and_sampling(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = levels(sizes), defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= -(-rate // 1) and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 60, s
    assert sorted(map(repr, mix(docs).collect())) == sorted(map(repr, got))


def test_emitted_rows_follow_copies(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 3}", "x") for i in range(200)] + [(7, "w " * 8, "s1", "x")] * 3, "doc_id long, text string, source string, size string")
    counts = {}
    for r in mix(docs.drop("size")).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.copies
    out = emit(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in counts.items() if v})


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "", "a"), (2, "one", None), (2, "one", None), (3, "x " * 50_000, "b")], "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == 5 and all(r.taken <= 3 * r.size for r in got)
    assert {r.target for r in got if r.source == "a"} == {0.0}
    assert mix(docs.limit(0)).collect() == [] and emit(docs.limit(0)).collect() == []
