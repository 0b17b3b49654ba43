import hashlib
import itertools
import re

from pyspark.sql import functions as F

from tessera.llm.merkle import branches, fingerprints, leaves, likeness, locate, tree

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_root(text):
    p = [SHA("P" + x) for x in text.split("\n")]
    s = [SHA("S" + "|".join(p[i : i + 8])) for i in range(0, len(p), 8)]
    return SHA(f"R{len(p)}|" + "|".join(s))


def brute_leaves(line):
    words, out = re.findall(r"[^ ]+ *|^ +", line), []
    for w in words:
        if out and not w.startswith(" ") and len(out[-1]) < 16 and not (end := out[-1][-1].rstrip(" "))[-1:] in ("", "e", ".", ","):
            out[-1].append(w)
        else:
            out.append([w])
    return ["".join(x) for x in out]


def brute_near(a, b):
    if a == b:
        return 1.0
    x, y = a.split("\n"), b.split("\n")
    same = sum(len(brute_leaves(p)) for p, q in zip(x, y) if p == q)
    rest = lambda x, y: {leaf for i, p in enumerate(x) if i >= len(y) or y[i] != p for leaf in brute_leaves(p)}
    rx, ry = rest(x, y), rest(y, x)
    whole = 2 * same + len(rx) + len(ry)
    return (2 * same + 2 * len(rx & ry)) / whole if whole else 0.0


def brute(rows):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]

        out[doc_id] = (len(text), SHA(edited), brute_root(text), brute_root(edited), brute_near(text, edited), brute_near(text, after), [i for i, (p, q) in enumerate(itertools.zip_longest(text.split("\n"), edited.split("\n"))) if p != q])
    return out


def test_brute_force_with_edges(spark):
    rows = [(5, "one two three four five six seven\nnext line here\n" * 5), (7, None), (1, ""), (9, "é" * 9), (10, "  two  leading, spaces here \n   \nthe end.  "), (11, "1 2 3 4 5 6 7 8 9 " * 30 + "\n" * 20), (None, "a b c d e"), (12, "x " * 5000), (30, "one two three four five six seven\nnext line here\n" * 5), (31, "one two three four five six seven\nnext line here\n" * 5)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in [*rows, rows[0]]], "doc_id long, text string, n_chars string")
    got = fingerprints(docs).collect()
    assert len(got) == len(rows) + 1
    want = brute(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == want[r.doc_id][:4]
        assert abs(r.near_edited - want[r.doc_id][4]) < 1e-12 and abs(r.near_next - want[r.doc_id][5]) < 1e-12
        at = want[r.doc_id][6]
        assert (r.first_edited, r.n_edited) == (at[0] if at else None, len(at))
    assert len({r.fingerprint for r in got if r.doc_id in (5, 30, 31)}) == 1
    assert next(r.near_next for r in got if r.doc_id == 30) == 1.0


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    r = fingerprints(one).first()
    assert r.edited_sha256 == SHA("a b c d e f g h"[:12] + "a b")
    assert fingerprints(one.limit(0)).collect() == []


def test_edits_are_located(spark):
    lines = [f"line {i}" for i in range(40)]
    changed = [*lines[:21], "other", *lines[22:], "more"]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string").select(tree(F.col("a")).alias("x"), tree(F.col("b")).alias("y"), leaves(F.col("a")).alias("l"))
    r = df.select(locate(F.col("x"), F.col("y")).alias("at"), locate(F.col("x"), F.col("x")).alias("none"), "l").first()
    assert r["at"] == [21, 40] and r["none"] == [] and len(r["l"]) == 80


def test_one_word_more_keeps_likeness_high(spark):
    words = "the quick brown fox jumps over the lazy dog, then takes some time off in a quiet place by the water. " * 12
    for at in (0, 300, len(words)):
        df = spark.createDataFrame([(words, words[:at] + "inserted " + words[at:])], "a string, b string")
        near = df.select(likeness(branches(F.col("a"), tree(F.col("a"))), branches(F.col("b"), tree(F.col("b")))).alias("n")).first()["n"]
        assert 0.7 < near < 1.0
    lines = "\n".join(f"paragraph {i} here, with words. And {i * i} more" for i in range(100))
    df = spark.createDataFrame([(lines, "one line more\n" + lines)], "a string, b string")
    assert df.select(likeness(branches(F.col("a"), tree(F.col("a"))), branches(F.col("b"), tree(F.col("b")))).alias("n")).first()["n"] > 0.95
