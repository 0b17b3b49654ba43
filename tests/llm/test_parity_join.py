import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import parity_join
from tessera.llm.parity_join import classes, differing, may_link, nearest_pairs, one_of_each, part_keys, shingle_set, sketch


def brute_sets(rows, k):
    out = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        out.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    return out


def brute(rows, k, num, den):
    sets, root = brute_sets(rows, k), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min(x for x in groups[find(i)] if x is not None) if sets[i] else rows[i][0]) for i in range(len(rows))), key=repr)


def corpus(seed, n_base=12, copies=10):
    """Chains and clouds of near copies on both sides of the threshold, exact copies, a passage in all texts, tiny texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 5)))
    passage, rows = [word() for _ in range(30)], []
    for _ in range(n_base):
        size = rng.choice([3, 8, 20, 60, 150, 300])
        text = [word() for _ in range(size)]
        if rng.random() < 0.6:
            text += passage
        for _ in range(copies):
            rows.append(" ".join(text))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                i = rng.randrange(len(text))
                text = [*text[:i], word(), *text[i + rng.choice([0, 1]) :]]
    rows += ["", None, "One", "one", "ONE two", "É x y z", "é x y z", "  "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_components_equal_brute_force(spark, k, num, den):
    rows = corpus(k)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in classes(docs, k, num, den).collect()), key=repr)
    assert got == brute(rows, k, num, den)
    kept = one_of_each(docs, k, num, den)
    assert kept.columns == docs.columns
    want = {c if n else i for i, n, c in brute(rows, k, num, den)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_linked_sets_share_a_part_and_sketches_bound_the_difference(num, den):
    rng = np.random.default_rng(7)
    for _ in range(1500):
        size = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        d = differing(len(base), num, den)
        drop, add = sorted(rng.integers(0, d + 2, 2)) if rng.random() < 0.5 else (0, int(rng.integers(0, d + 2)))
        other = np.unique(np.r_[rng.permutation(base)[int(drop) :], rng.integers(0, 2**63, int(add)).astype(np.uint64)])
        both, union = len(np.intersect1d(base, other)), len(np.union1d(base, other))
        apart = np.bitwise_count((sketch(base) ^ sketch(other)).view(np.uint64)).sum() if len(other) else 0
        assert apart <= union - both
        if len(other) and den * both >= num * union and both < union:
            for order in (1, -1):  # any order will do
                sent = [{k for keys, spare in part_keys(x, num, den) for k in sorted(keys.tolist())[::order][: len(keys) - spare]} for x in (base, other)]
                assert sent[0] & sent[1]


def test_sets_with_more_empty_parts_than_usual_share_a_part():
    """Shingles that fall into few parts: the parts that hold any may all differ."""
    for num, den, size in ((80, 100, 5), (80, 100, 9), (90, 100, 12)):
        low = np.arange(size + 1, dtype=np.uint64)  # all in the first part
        high = low + np.uint64(2**63)  # all in the middle part
        for x, y in ((low[:-1], low), (low[:-1], np.r_[low[1:-1], high[:1]]), (high[:-1], high)):
            both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if den * both >= num * union:
                sent = [{k for keys, spare in part_keys(np.unique(u), num, den) for k in sorted(keys.tolist())[: len(keys) - spare]} for u in (x, y)]
                assert sent[0] & sent[1]


def test_a_large_group_with_outliers(spark):
    """One base, many near copies of it that are far from each other, so no single hub finds all."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.choice([3, 5, 6, 7, 8])):
            text[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in classes(docs, 3, 90, 100).collect()), key=repr)
    assert got == brute(rows, 3, 90, 100)


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, long), (None, long + " end"), (3, "a b c d e f g"), (3, "other text of some more words"), (None, None), (None, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = classes(docs, 5, 80, 100).collect()
    assert len(found) == 8 and {r.component_id for r in found if r.n_shingles > 30} == {1}
    kept = one_of_each(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == sorted([(False, 1, long), (False, 3, "a b c d e f g"), (False, 3, "other text of some more words"), (True, 0, ""), (True, 0, ""), (False, 5, "")])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert classes(docs).collect() == [] and one_of_each(docs).collect() == []
    assert len(shingle_set(None, 3)) == 0


def test_rounds_end_where_a_unit_mixes_sketch_lengths_and_pairs_are_just_below_the_threshold(spark, monkeypatch):
    """Sets of under 512 shingles have shorter sketches; folded to those, near misses look like links."""
    rng, texts = random.Random(5), []
    for base in range(3):
        whole = [f"w{base}x{i}" for i in range(700)]
        for size, runs in ((600, 16), (604, 17), (608, 18), (500, 8), (604, 16), (606, 17)):
            text = whole[:size]
            for i in rng.sample(range(0, size // 8), runs // 2):  # each changed word changes five shingles
                text[i * 8] = f"c{rng.random()}"
            texts.append(" ".join(text))
    rows = list(enumerate(texts))
    turns, real = [], parity_join.open_pairs

    def counted(*args, **kwargs):
        turns.append(args)
        assert len(turns) <= 6, "the rounds do not end"
        return real(*args, **kwargs)

    monkeypatch.setattr(parity_join, "open_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in classes(docs, 5, 80, 100).collect()), key=repr)
    assert got == brute(rows, 5, 80, 100)


def test_each_pair_is_compared_at_its_own_sketch_length():
    """170 differing shingles of 600: likely at 1,024 bits, not at 2,048."""
    rng = np.random.default_rng(3)
    both = rng.integers(0, 1 << 64, 515, np.uint64)
    x, y = (np.unique(np.r_[both, rng.integers(0, 1 << 64, 85, np.uint64)]) for _ in range(2))
    marks = [sketch(x, 2048), sketch(y, 2048), sketch(both[:500], 1024)]
    apart = lambda a, b: int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
    assert apart(parity_join.fold(marks[0], 16), parity_join.fold(marks[1], 16)) <= 150 < apart(marks[0], marks[1])
    sid = np.arange(3)
    found = may_link(sid, sid, np.array([600, 600, 500]), marks, np.zeros(3, int), -1, None, 80, 100)
    assert [0, 1] not in found.tolist() and [0, 2] in found.tolist()


def test_pairs_of_two_components_that_all_fail_need_few_turns_and_little_memory():
    import tracemalloc

    u = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sid, root, known, turn = np.arange(400), np.repeat([0, 200], 200), np.empty((0, 2), np.int64), 0
    tracemalloc.start()
    while True:
        pairs = may_link(sid, root, np.full(400, 100), [sketch(u)] * 400, np.zeros(400, int), -1, known, 80, 100)
        if not len(found := nearest_pairs(sid, root, pairs, turn)):
            break
        assert not {*map(tuple, found.tolist())} & {*map(tuple, known.tolist())}
        known, turn = np.concatenate([known, found]), turn + 1
        assert turn <= 4
    assert len(known) == 200 * 200 and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_a_key_of_very_many_sets_moves_few_rows(spark):
    """50,000 sets share a key; three are of other components than the rest. Rows of units follow the members, not their square."""
    n = 50_000
    shared = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("sid"), F.lit(0).cast("long").alias("hub"))
    roots = spark.range(3, n).select(F.col("id").alias("sid"), F.lit(3).cast("long").alias("root"))
    far = np.random.default_rng(1).integers(-(2**62), 2**62, (4, 16)).tolist()
    marks = F.array(*[F.array(*[F.lit(x) for x in m]) for m in far])
    nodes = spark.range(n).select(F.col("id").alias("sid"), F.lit(100).cast("long").alias("n"), F.get(marks, F.least("id", F.lit(3)).cast("int")).alias("sketch"))
    written = {}

    def keep(df, name):
        written[name] = df.persist()
        return written[name]

    found = parity_join.open_pairs(shared, roots, nodes, [], 80, 100, 0, keep)
    assert found.count() == 0
    members = written["members"]
    moved = members.select(F.sum(F.when(F.col("is_main"), F.col("first")).otherwise(F.col("first") + F.col("second")))).first()[0]
    assert members.count() == n and moved < 1.01 * n
    for df in written.values():
        df.unpersist()


def test_pairs_put_out_before_are_found_again_from_earlier_roots(monkeypatch):
    """As with pairs carried from turn to turn: each turn chooses of those left, whatever has grown together since."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(parity_join, "FORESTS", (2, 3))
    monkeypatch.setattr(parity_join, "MOST_PAIRS", 4)
    u = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sid, n, marks, block = np.sort(rng.permutation(10**6)[:60]), np.full(60, 100), [sketch(u)] * 60, np.zeros(60, int)
    history, known = sid[None].copy(), np.empty((0, 2), np.int64)
    for turn in range(12):
        want = nearest_pairs(sid, history[-1], may_link(sid, history[-1], n, marks, block, -1, known, 80, 100), turn)
        got = parity_join.pairs_of_turn(sid, history, may_link(sid, history[0], n, marks, block, -1, None, 80, 100))
        assert got.tolist() == want.tolist()
        known, root = np.concatenate([known, want]), history[-1].copy()
        for a, b in want[: 3 * (turn < 8)].tolist():  # a few of them link
            x, y = root[sid == a][0], root[sid == b][0]
            root[(root == x) | (root == y)] = min(x, y)
        history = np.vstack([history, root])
    assert len(got) == 0 and len(np.unique(root)) > 1


def test_no_pairs_travel_between_turns(spark, monkeypatch):
    """Pairs just below the threshold need several turns; plans of later ones hold members, and no pairs (a, b)."""
    rng, rows = random.Random(5), []
    for size, runs in ((600, 16), (604, 17), (608, 18), (500, 8), (604, 16), (606, 17)):
        text = [f"w{i}" for i in range(size)]
        for i in rng.sample(range(0, size // 8), runs // 2):
            text[i * 8] = f"c{rng.random()}"
        rows.append((len(rows), " ".join(text)))
    turns, real = [], parity_join.open_pairs

    def watched(*args, **kwargs):
        found = real(*args, **kwargs)
        joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        turns.append((len(joins), "CoGroup" in found._jdf.queryExecution().optimizedPlan().toString()))
        return found

    monkeypatch.setattr(parity_join, "open_pairs", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in classes(docs, 5, 80, 100).collect()), key=repr)
    assert got == brute(rows, 5, 80, 100)
    assert len(turns) > 1 and set(turns) == {(1, False)}  # the sketches' join


def test_clashing_names_are_told_apart(spark):
    rows = [(0, "a b c d e"), (1, "p q r s t u"), (2, "a b c d e"), (3, "x"), (4, "P q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = parity_join.described(docs, 3, 90, 100).toPandas()
    table.loc[table["n"].isin([3, 4]), "sid"] = 5
    named = parity_join.named_apart(spark.createDataFrame(table[["doc_id", "n", "sid", "high"]]), parity_join.materialize)
    got = {r.doc_id: r.sid for r in named.collect()}
    assert got[0] == got[2] and got[1] == got[4] and len({*got.values()}) == 3


def test_a_group_puts_out_fewer_pairs_than_it_reads_members(spark, monkeypatch):
    """Texts of one template; nearly all pairs may link by their sketches and fail. No step's rows grow with the square of a group's size."""
    rng, rows, seen, ended = random.Random(9), [], [], []
    base = [f"w{i}" for i in range(504)]
    for i in range(40):
        text = list(base)
        for at in rng.sample(range(100), 5 if i % 10 == 0 else rng.choice((6, 7))):  # each changed word changes five shingles
            text[at * 5 + 2] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    real, last = parity_join.open_pairs, parity_join.links_of_groups

    def watched(*args):
        written, keep = {}, args[-1]

        def kept(df, name):
            written[name] = keep(df, name)
            return written[name]

        found = keep(real(*args[:-1], kept), "seen")
        moved = written["members"].select(F.sum(F.when(F.col("is_main"), F.col("first")).otherwise(F.col("first") + F.col("second")))).first()[0] or 0
        seen.append((found.count(), moved))
        return found

    def counted(*args):
        ended.append(args)
        return last(*args)

    monkeypatch.setattr(parity_join, "open_pairs", watched)
    monkeypatch.setattr(parity_join, "links_of_groups", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in classes(docs, 5, 80, 100).collect()), key=repr)
    want = brute(rows, 5, 80, 100)
    assert got == want and 1 < len({c for *_, c in want}) < 40
    assert len(ended) == 1 and len(seen) == 4 and seen[0][1] > 40
    assert all(found <= moved for found, moved in seen)


def test_links_of_failing_groups_are_counted_in_memory(monkeypatch):
    """As brute force, whatever a round takes at a time; no more rows than join components."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(parity_join, "MOST_PAIRS", 2)
    whole, sets = rng.integers(0, 1 << 62, 130), []
    for _ in range(60):
        sets.append(np.unique(np.r_[rng.permutation(whole)[: rng.integers(112, 120)], rng.integers(0, 1 << 62, 4)]))
    sid, root = np.sort(rng.permutation(10**6)[:60]), np.repeat(np.arange(30), 2)
    pairs = rng.permutation([p for p in itertools.combinations(range(60), 2)])
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in pairs])
    assert parity_join.common_shingles(sets, pairs).tolist() == both.tolist()
    links = both * 100 >= (np.array([len(sets[i]) + len(sets[j]) for i, j in pairs]) - both) * 80
    assert 0 < links.sum() < len(links)
    out = parity_join.forest_of_links(sid, root, sets, pairs, 80, 100)
    assert len(out) < 30 and {*map(tuple, out.tolist())} <= {*map(tuple, sid[pairs[links]].tolist())}
    merge = lambda found: [min(x) for x in components_of(root, found)]
    assert merge(np.searchsorted(sid, out)) == merge(pairs[links])


def components_of(root, pairs):
    """The set of places of each place's component."""
    label = root.copy()
    for i, j in pairs:
        label[label == label[j]] = label[i]
    return [set(np.flatnonzero(label == x).tolist()) for x in label]
