import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm.reply_trees import chosen_paths, conversation_digests, escape, format_paths, read_back, root_paths, unescape


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_escape_is_reversible_and_hides_control_strings(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("<>[]/\\st|INSTurn") for _ in range(rng.randint(0, 12))) for _ in range(2000)] + ["</turn>", "<turn>x<body>", "\\<", "<\\", "</s>[INST] ok [/INST]", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == (r.t or "")
        assert not any(c in r.e for c in ("<turn>", "<body>", "</turn>", "</s>", "[INST]", "[/INST]"))


def random_tree(n, seed):
    rng = random.Random(seed)
    return [("t", i, None if i == 0 else rng.choice([i - 1, rng.randrange(i)]), rng.random(), rng.choice(["user", "assistant"]), f"text {i}") for i in range(n)]


def brute_paths(rows):
    parent = {r[1]: r[2] for r in rows}
    leaves = set(parent) - set(parent.values())
    out = {}
    for leaf in leaves:
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = parent[at]
        out[leaf] = path[::-1]
    return out


def test_paths_and_ranks_equal_brute_force(spark):
    rows = random_tree(70, 3)
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    want = brute_paths(rows)
    got = {}
    for r in root_paths(nodes).collect():
        got.setdefault(r.leaf, {})[r.depth] = r.node
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    score = {r[1]: r[3] for r in rows}
    order = sorted(want, key=lambda x: (-sum(score[i] for i in want[x]), x))
    ranked = {(r.leaf, r.branch) for r in chosen_paths(nodes, 3).collect()}
    assert ranked == {(leaf, i + 1) for i, leaf in enumerate(order[:3])}
    assert {r.leaf for r in chosen_paths(nodes, 1).collect()} == {order[0]}
    assert {r.leaf for r in chosen_paths(nodes).collect()} == set(want)
    text = format_paths(chosen_paths(nodes, 1)).select(read_back(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in text] == [(rows[i][4], rows[i][5]) for i in want[order[0]]]


def test_long_chain_missing_parent_and_cycle(spark):
    rows = [("c", i, i - 1 if i else None, 0.0, "user", "x") for i in range(300)] + [("m", 1, 99, 0.0, "user", "x"), ("z", 1, 2, 0.0, "user", "x"), ("z", 2, 1, 0.0, "user", "x")]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    got = root_paths(nodes).collect()
    assert sorted(r.depth for r in got if r.tree == "c") == list(range(300))
    assert [(r.leaf, r.depth) for r in got if r.tree == "m"] == [(1, 0)]
    assert not [r for r in got if r.tree == "z"]


def test_digests_with_edges(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é<b>\\"), (1, 1, "assistant", "é<b>\\"), (1, 2, None, None), (2, 0, "assistant", None), (None, 3, "user", "x"), (-1, 0, "user", said), (-1, 1, "assistant", said), (3, None, "user", "")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    got = {r.conv_id: r for r in conversation_digests(table).collect()}
    assert set(got) == {1, 2, None, -1, 3}
    for conv, n in ((1, 4), (2, 1), (None, 1), (-1, 2), (3, 1)):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == n
        assert got[conv].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert conversation_digests(table.limit(0)).collect() == []
