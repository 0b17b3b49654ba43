"""Triples from sentences by patterns, and questions to the graph they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import sentences, strip

# The verbs in order, and the shapes of the three kinds of sentences.
VERBS = ("uses", "retrieves", "enables", "fits", "packs", "provides", "builds")
CHARS = r"[\p{L}\p{N}_\s-]"
IS_A = rf"(?i)^([A-Z]{CHARS}{{0,80}}?)\s+is\s+(?:an?|the)\s+({CHARS}{{1,120}})$"
VERB = rf"(?i)^({CHARS}{{1,80}}?)\s+%s\s+({CHARS}{{1,120}})$"
ARROW = rf"^({CHARS}{{1,80}})\s*->\s*({CHARS}{{1,120}})$"


#: Relations and their patterns, in the order in which a sentence's triples stand.
RULES = (("is_a", IS_A), *((v, VERB % v) for v in VERBS), ("->", ARROW))


def _match(sentence: Column, seq: int) -> Column:
    rel, pattern = RULES[seq]
    part = lambda g: strip(F.regexp_extract(sentence, pattern, g))
    return F.when(sentence.rlike(pattern), F.struct(F.lit(seq).alias("seq"), part(1).alias("head"), F.lit(rel).alias("rel"), part(2).alias("tail")))


def sentence_triples(sentence: Column, corrected: bool = False) -> Column:
    """Array of (seq, head, rel, tail): is-a, then one per verb, then the arrow form; seq tells which, from 0.

    A sentence that ends in punctuation matches nothing; ``corrected`` takes the punctuation off first.
    """
    s = F.regexp_replace(sentence, r"[.!?]+$", "") if corrected else sentence
    return F.filter(F.array(*(_match(s, i) for i in range(len(RULES)))), lambda t: t.isNotNull())


def triples(texts: DataFrame, corrected: bool = False) -> DataFrame:
    """(doc_id, sent, seq, head, rel, tail); repeats are kept, (doc_id, sent, seq) is their order.

    ``seq`` is the place of the pattern, so it also orders sentences of different texts that share a doc_id: is-a first, arrows last.
    """
    split = texts.select("doc_id", F.posexplode(sentences("text")).alias("sent", "sentence"))
    return split.select("doc_id", "sent", F.explode(sentence_triples(F.col("sentence"), corrected)).alias("t")).select("doc_id", "sent", "t.seq", "t.head", "t.rel", "t.tail")


def nodes(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("head").alias("node")).unionByName(graph.select(F.col("tail").alias("node"))).distinct()


def neighbors(graph: DataFrame, node: str) -> DataFrame:
    """Outgoing (rel, tail), repeats kept."""
    return graph.where(F.col("head") == node).select("doc_id", "sent", "seq", "rel", "tail")


def find(graph: DataFrame, pattern: str) -> DataFrame:
    """Triples in which the pattern occurs in some part, whatever the case."""
    rx = f"(?i){pattern}"
    return graph.where(F.col("head").rlike(rx) | F.col("rel").rlike(rx) | F.col("tail").rlike(rx))


#: Triples of a graph that one document may hold; a graph beyond that is exported by parts or as a table.
MOST_DRAWN = 5_000_000


def _drawable(graph: DataFrame) -> DataFrame:
    if graph.limit(MOST_DRAWN + 1).count() > MOST_DRAWN:
        raise ValueError(f"the graph has more than {MOST_DRAWN} triples, too many for one document; write the table of triples instead")
    return graph


def _ordered(graph: DataFrame, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "sent", "seq", value.alias("v")))), lambda x: x["v"])


def to_dot(graph: DataFrame, name: str = "G") -> DataFrame:
    """One row ``dot``; names are not escaped. An error beyond MOST_DRAWN triples."""
    line = F.concat(F.lit('  "'), "head", F.lit('" -> "'), "tail", F.lit('" [label="'), "rel", F.lit('"];'))
    lines = _drawable(graph).agg(_ordered(graph, line).alias("lines"))
    # fixed value: the layout line
    top = F.array(F.lit(f"digraph {name} {{"), F.lit("  rankdir=LR; node [shape=box, style=rounded];"))
    return lines.select(F.array_join(F.concat(top, F.col("lines"), F.array(F.lit("}"))), "\n").alias("dot"))


def to_json(graph: DataFrame) -> DataFrame:
    """One row ``json``: sorted nodes, and triples in order as [head, rel, tail]. An error beyond MOST_DRAWN triples."""
    listed = _drawable(graph).agg(_ordered(graph, F.array("head", "rel", "tail")).alias("triples"))
    named = nodes(graph).agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return named.crossJoin(listed).select(F.to_json(F.struct("nodes", "triples")).alias("json"))
