"""Reply trees to training conversations. DataFrame functions only.

Nodes of a tree name their parent. In each round the pointers to the 2**k-th ancestor are joined with themselves, so a
chain of n turns takes log2(n) self-joins; each pointer also holds the sum of the scores it passes, so that every
leaf's total is known before any path is written out. Each leaf is a branch; branches of a tree are ranked by their
totals (ties: the smaller leaf), and only chosen leaves then collect their ancestors, from the longest pointers
down. Each chosen path is formatted as one conversation.

The template writes a turn as ``<turn>role<body>text</turn>``. In roles and texts ``\\`` is doubled and
then ``<`` and ``[`` are followed by a ``\\``, so neither these marks nor other control strings such as
``</s>`` or ``[INST]`` can occur inside them; taking the ``\\`` after each ``<`` and ``[`` away and then
halving the others restores them.

Rows whose parent is null or missing are roots; nodes in a cycle have no root and are left out. Null texts
and roles are empty, a null score counts 0, a null tree id is a tree of its own, and repeated rows are turns like others.
A conversation becomes one text and so one row, however long; nothing else gathers a tree in one task.
Extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_numbers, with_range_block

TURN, BODY, END = "<turn>", "<body>", "</turn>"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("<\\"), F.lit("<")), F.lit("[\\"), F.lit("["))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _pointers(nodes: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: (tree, node, up, total) with the 2**k-th ancestor ``up`` (null beyond the root) and the sum of the
    scores of the node and of those between, without ``up``'s. In the last all are beyond the root, but for nodes
    that a cycle keeps from it.
    """
    base = nodes.select("tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("total"))
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    first = base.join(known, ["tree", "parent"], "left").select("tree", "node", F.expr("if(known, parent, null)").alias("up"), "total")
    pointers, before = [materialize(first, "pointers")], None
    while (left := pointers[-1].where("up is not null").count()) and left != before:  # of nodes with a root some get there in each round
        last, before = pointers[-1], left
        above = last.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"))
        further = last.where("up is not null").join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        pointers.append(materialize(last.where("up is null").select("tree", "node", "up", "total").unionByName(further), "pointers"))
    return pointers


def _leaves(pointers: list[DataFrame]) -> DataFrame:
    """(tree, leaf, total) of the nodes that are nobody's parent and have a root: the sum of the scores from there to the root."""
    parents = pointers[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    return pointers[-1].where("up is null").join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "total")


def _paths(pointers: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """(tree, leaf, node, depth) for each of the leaves and each node on its path from the root, depth 0 at the root."""
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("steps"))
    for k in range(len(pointers) - 1, -1, -1):
        up = pointers[k].where("up is not null").drop("total")
        paths = paths.unionByName(paths.join(up, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("steps") + F.lit(2**k)).alias("steps")))
        paths = materialize(paths, "paths")
    deepest = paths.groupBy("tree", "leaf").agg(F.max("steps").alias("deepest"))
    return paths.join(deepest, ["tree", "leaf"]).select("tree", "leaf", "node", (F.col("deepest") - F.col("steps")).alias("depth"))


def root_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, depth) of every leaf. ``nodes`` has tree, node, parent (unique non-null tree and node, null parent at a root)."""
    pointers = _pointers(nodes if "score" in nodes.columns else nodes.withColumn("score", F.lit(0.0)))
    return _paths(pointers, _leaves(pointers))


def chosen_paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """Turns (tree, leaf, branch, depth, role, text) of the ``branches`` best paths of each tree (None: all).

    ``nodes`` has tree, node, parent, score, role, text. ``branch`` counts from 1 at the highest score.
    """
    pointers = _pointers(nodes)
    totals = _leaves(pointers)
    if branches == 1:  # an aggregate, so that a tree of very many branches needs no single task
        ranked = totals.groupBy("tree").agg(F.max(F.struct("total", (-F.col("leaf")).alias("leaf"))).alias("b")).select("tree", (-F.col("b.leaf")).alias("leaf"), F.lit(1).alias("branch"))
    else:
        ranked = totals.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("total").desc(), "leaf"))).drop("total")
        ranked = ranked if branches is None else ranked.where(F.col("branch") <= branches)
    ranked = materialize(ranked, "branches")
    turns = _paths(pointers, ranked).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    return turns.join(ranked, ["tree", "leaf"]).select("tree", "leaf", "branch", "depth", "role", "text")


def format_paths(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(tree, leaf, branch, formatted, loss_spans): the text of each path, and [start, length) in code points to train on."""
    written = turns.select(
        "tree", "leaf", "branch", "depth",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"), escape(F.col("text")).alias("body"),
        F.coalesce(F.col("role") == trained_role, F.lit(False)).alias("trained"),
    )
    size = F.length("head") + F.length("body") + F.lit(len(END))
    start = F.sum(size).over(Window.partitionBy("tree", "leaf").orderBy("depth")) - F.length("body") - F.lit(len(END))
    placed = written.withColumn("span", F.when(F.col("trained"), F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    whole = placed.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "head", "body", "span"))).alias("turns"))
    return whole.select(
        "tree", "leaf", "branch",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    body = lambda p: F.substring_index(p, BODY, -1)
    head = lambda p: F.substring(F.substring_index(p, BODY, 1), F.lit(len(TURN) + 1), F.length(p))
    return F.transform(parts, lambda p: F.struct(unescape(head(p)).alias("role"), unescape(body(p)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def linear_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of (conv_id, turn, role, text) rows: each replies to the one before it; ties by role and text.

    Rows are numbered over the whole table, which is range-partitioned, so that a conversation with a large share of
    all rows is dealt over many tasks.
    """
    keyed = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "turn", "role", "text")
    order = (F.col("tree").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = materialize(row_numbers(with_range_block(keyed, *order), *order), "numbered")
    first = numbered.groupBy("tree").agg(F.min("position").alias("first"))
    parent = F.when(F.col("position") > F.col("first"), F.col("position") - 1)
    return numbered.join(first, "tree").select("tree", F.col("position").alias("node"), parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Formats every conversation's best path and reports what is read back from the output."""
    nodes = materialize(linear_nodes(rows), "nodes")
    formatted = format_paths(chosen_paths(nodes, branches=1))
    read = formatted.select("tree", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.expr("if(tree = 'null', null, cast(tree as bigint))").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "utf-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
