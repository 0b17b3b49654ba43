"""Merkle fingerprints of documents. DataFrame functions only.

A text is a tree: the root over sections (every ``SECTION`` paragraphs), a section over its paragraphs
(lines), a paragraph over its text. Each node is a SHA-256 of its children's, with their number and a
mark of the level, so roots are equal just when texts are (up to hash collisions), and walking down the
branches that differ locates an edit.

Two trees are compared by that walk. Sections at the same place with equal nodes are passed over, then paragraphs
at the same place; what is passed over is common. Paragraphs that differ are opened: they are cut into leaves,
runs of up to ``LEAF_WORDS`` words that end after a word whose last character is in ``LEAF_END`` (or with the
line). Such ends go by content, so that a word put in or taken out changes the one or two leaves around it, and
not all that follow. Leaves are known by 64-bit hashes. With ``same`` leaves passed over, a and b distinct leaves
in the opened parts and c of them common, the likeness is (2 same + 2 c) / (2 same + a + b), 1 for equal roots, and
0 where texts that differ have no leaves at all.

Null texts count as empty; an empty text has one empty paragraph and no leaves. A document is a distinct pair
of doc_id and text: repeated rows are returned as often as they come, with equal values, and "next"
means the next distinct pair by (doc_id, nulls first; then the text's hash). Extra columns are not read;
an empty table gives an empty table. Very long texts are one row: their trees grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bind

from .common import materialize, with_range_block

SECTION, LEAF_WORDS = 8, 16
#: Characters at the end of a word that end a leaf.
LEAF_END = "e.,"
#: A leaf; words are runs without space or line feed, and spaces at the start of a line are a leaf of their own.
LEAF = rf"(?:[^ \n]++(?<![{LEAF_END}]) ++){{0,{LEAF_WORDS - 1}}}[^ \n]++ *+| ++"


def tree(text: Column) -> Column:
    """Struct of root (hex), sections and paragraphs (arrays of hex)."""
    return bind(text, lambda t: bind(F.transform(F.split(t, "\n"), lambda p: F.sha2(F.concat(F.lit("P"), p), 256)), _levels))


def _levels(paragraphs: Column) -> Column:
    count = F.size(paragraphs)
    sections = F.transform(
        F.sequence(F.lit(0), (count - 1).cast("int") - F.pmod(count - 1, F.lit(SECTION)), F.lit(SECTION)),
        lambda at: F.sha2(F.concat(F.lit("S"), F.array_join(F.slice(paragraphs, at + 1, SECTION), "|")), 256),
    )
    made = lambda s: F.struct(F.sha2(F.concat(F.lit("R"), count.cast("string"), F.lit("|"), F.array_join(s, "|")), 256).alias("root"), s.alias("sections"), paragraphs.alias("paragraphs"))
    return bind(sections, made)


def leaves(line: Column) -> Column:
    """64-bit hashes of the leaves of one line, in order."""
    return F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x))


def branches(text: Column, nodes: Column) -> Column:
    """What the walk looks at: an array of sections (node, size, paragraphs), each paragraph with its node and leaves.

    Nodes are the first 64 bits of the tree's (``nodes`` is ``tree(text)``).
    """
    short = lambda h: F.conv(F.substring(h, 1, 15), 16, 10).cast("long")
    lines = F.zip_with(F.split(text, "\n"), nodes["paragraphs"], lambda p, h: F.struct(short(h).alias("node"), leaves(p).alias("leaves")))
    return bind(lines, lambda ps: F.transform(nodes["sections"], lambda h, i: _section(short(h), F.slice(ps, i * SECTION + 1, SECTION))))


def _section(node: Column, paragraphs: Column) -> Column:
    size = F.aggregate(paragraphs, F.lit(0), lambda n, p: n + F.size(p["leaves"]))
    return F.struct(node.alias("node"), size.alias("size"), paragraphs.alias("paragraphs"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two ``branches``, walking down from the sections; see the module's text."""
    none = F.array().cast("array<bigint>")

    def opened(x: Column, y: Column) -> Column:
        """Of two sections: (same, leaves of x, leaves of y that differ)."""
        pairs = F.zip_with(
            F.coalesce(x["paragraphs"], F.array()), F.coalesce(y["paragraphs"], F.array()),
            lambda p, q: F.when(p["node"] == q["node"], F.struct(F.size(p["leaves"]).alias("same"), none.alias("x"), none.alias("y")))
            .otherwise(F.struct(F.lit(0).alias("same"), F.coalesce(p["leaves"], none).alias("x"), F.coalesce(q["leaves"], none).alias("y"))),
        )
        return bind(pairs, total)

    def total(parts: Column) -> Column:
        same = F.aggregate(parts, F.lit(0), lambda n, p: n + p["same"])
        flat = lambda name: F.flatten(F.transform(parts, lambda p: p[name]))
        return F.struct(same.alias("same"), flat("x").alias("x"), flat("y").alias("y"))

    sections = F.zip_with(a, b, lambda x, y: F.when(x["node"] == y["node"], F.struct(x["size"].alias("same"), none.alias("x"), none.alias("y"))).otherwise(opened(x, y)))

    def share(t: Column) -> Column:
        return bind(F.array_distinct(t["x"]), lambda x: bind(F.array_distinct(t["y"]), lambda y: ratio(t["same"], x, y)))

    def ratio(same: Column, x: Column, y: Column) -> Column:
        whole = (2 * same + F.size(x) + F.size(y)).cast("double")
        return F.when(whole == 0, 0.0).otherwise((2 * same + 2 * F.size(F.array_intersect(x, y))).cast("double") / whole)

    return bind(bind(sections, total), share)


def locate(a: Column, b: Column) -> Column:
    """Places (from 0) at which the paragraphs of two trees differ, looking only into sections that differ."""

    def inside(i: Column) -> Column:
        at = F.filter(F.sequence(i * SECTION, i * SECTION + SECTION - 1), lambda j: (j < F.size(a["paragraphs"])) | (j < F.size(b["paragraphs"])))
        return F.filter(at, lambda j: ~F.get(a["paragraphs"], j).eqNullSafe(F.get(b["paragraphs"], j)))

    differ = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a["sections"]), F.size(b["sections"])) - 1), lambda i: ~F.get(a["sections"], i).eqNullSafe(F.get(b["sections"], i)))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(F.flatten(F.transform(differ, inside)))


def keyed(docs: DataFrame) -> DataFrame:
    """(id, absent, hash, text): a null doc_id is id 0 and absent, so that joins and windows share one partitioning."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("absent"), F.xxhash64(text).alias("hash"), text.alias("text"))


KEY = ["id", "absent", "hash"]


def next_documents(docs: DataFrame) -> DataFrame:
    """(id, absent, hash, n_chars, next) of each distinct document, without a single task over rows.

    Ids are range-partitioned; inside a block the next row is at hand, and a block's last row gets the first
    row of the next block from a table with one row per block.
    """
    slim = docs.groupBy(*KEY).agg(F.first("n_chars").alias("n_chars"))
    order = (F.col("absent").desc(), F.col("id").asc(), F.col("hash").asc())
    ranged = with_range_block(slim, *order)
    at = F.struct((~F.col("absent")).alias("present"), "id", "hash")
    firsts = ranged.groupBy("block").agg(F.min(at).alias("first"))
    over = Window.orderBy("block")
    wrap = F.min("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = firsts.select("block", F.coalesce(F.lead("first").over(over), wrap).alias("following"))
    inside = F.lead(at).over(Window.partitionBy("block").orderBy(*order))
    return ranged.withColumn("inside", inside).join(following, "block").select(*KEY, "n_chars", F.coalesce("inside", "following").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, likenesses, and where the edit is found; see the module's text.

    The texts are shuffled once, to meet their neighbour's id; then each sends the first characters and the
    branches that its predecessor needs. ``first_edited`` is the first paragraph (from 0) at which the trees of a text
    and its edited text differ, null if none, and ``n_edited`` the number of such places.
    """
    base = keyed(docs)
    order = materialize(next_documents(base.select(*KEY, F.length("text").alias("n_chars"))), "order")
    before = order.select(
        F.col("next.id").alias("id"), (~F.col("next.present")).alias("absent"), F.col("next.hash").alias("hash"),
        F.struct(*KEY).alias("to"), F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"),
    )
    one = F.row_number().over(Window.partitionBy(*KEY).orderBy("hash"))
    met = base.join(before, KEY).withColumn("one", one).where("one = 1").withColumn("tree", tree(F.col("text")))
    sent = met.select(
        "to.id", "to.absent", "to.hash",
        F.substring("text", F.lit(1), F.col("quarter")).alias("prefix"), F.col("tree.root").alias("next_root"), branches(F.col("text"), F.col("tree")).alias("next_branches"),
    )
    pairs = base.join(sent, KEY).withColumn("n_chars", F.length("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), "prefix"))
    trees = edited.withColumns({"tree": tree(F.col("text")), "edited_tree": tree(F.col("edited"))})
    c = F.col
    walked = trees.select(
        F.when(~c("absent"), c("id")).alias("doc_id"), c("n_chars").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        c("tree.root").alias("fingerprint"), c("edited_tree.root").alias("edited_fingerprint"), "next_root", "next_branches",
        branches(c("text"), c("tree")).alias("own"), branches(c("edited"), c("edited_tree")).alias("edited"), locate(c("tree"), c("edited_tree")).alias("at"),
    )
    near = lambda root, other: F.when(c("fingerprint") == c(root), 1.0).otherwise(likeness(c("own"), c(other)))
    return walked.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint", "edited").alias("near_edited"), near("next_root", "next_branches").alias("near_next"),
        F.get("at", F.lit(0)).cast("long").alias("first_edited"), F.size("at").cast("long").alias("n_edited"),
    )
