"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each source's share of all words is set by its weight, no target above ``cap`` times the source's own
size; the excess goes to the others by weight. Within a source every document has the same expected number
of copies r = target / size. Documents stand in a fixed order, the prefix sum of the expected copies of
the i-th is i * r, and with an offset u the document is emitted once for each integer in
(u + i * r, u + (i + 1) * r], so floor(r) or ceil(r) times.

The order within a source is by size class (four to an octave), so that every stretch of the prefix sum
holds documents of like size and the words taken follow the target; inside a class documents are dealt
into parts by id, ``splits`` for every four million documents. Positions come from counts of (source, class, part) and a numbering inside
each, so no task ever holds a whole source. The offset is one of ``offsets`` equally spaced ones that start
at a point drawn from the source's name: the one whose words come nearest to the target.

Null source: a source of its own, last in order. Null text: size 0. Null ids and repeated rows are
documents like others; which of equal rows gets the extra copy makes no difference to the rows returned.
Empty sources have target 0, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_numbers, with_range_block, word_count


def source_key() -> Column:
    """A name that is never null; ``s`` before real ones keeps them apart from it."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))


def size_class(size: Column) -> Column:
    """Four classes to an octave: the bit length and the two bits after the first."""
    bits = F.length(F.bin(size))
    return (bits * 4 + F.when(bits >= 3, F.expr("cast(shiftright(size, length(bin(size)) - 3) & 3 as int)")).otherwise(0)).cast("int")


def source_targets(sized: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(key, source_size, n_docs, target) of each source; ``sized`` has key, source and size.

    Sources are numbered in order without a single task; the water level is found by a few sums.
    """
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = (F.col("source").asc_nulls_last(),)
    numbered = row_numbers(with_range_block(sources, *order), *order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    table = materialize(numbered.select("key", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")), "sources")
    kinds = sorted({float(w) for w in weights})

    def sums(full: Column) -> tuple[int, float, int]:
        """Sizes of the full sources, weights of the others, and how many are full; from whole numbers, so in any order alike."""
        rest = [F.count(F.when(~full & (F.col("weight") == w), 1)) for w in kinds]
        held, n_full, *counts = table.agg(F.sum(F.when(full, F.col("source_size"))), F.count(F.when(full, 1)), *rest).first()
        return held or 0, sum(w * n for w, n in zip(kinds, counts, strict=True)), n_full

    total = table.agg(F.sum("source_size")).first()[0] or 0
    _, rest, n_full = sums(F.lit(False))
    level = total / rest if rest else 0.0
    while True:  # full sources stay full, so there are at most as many rounds as sources
        held, rest, now = sums(F.col("weight") * F.lit(level) > F.col("most"))
        if now == n_full or not rest:
            break
        level, n_full = (total - cap * held) / rest, now
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("most"))).select("key", "source_size", "n_docs", "target")


def _copies(position: Column, rate: Column, offset: Column) -> Column:
    crossed = F.floor(offset + (position + 1) * rate) - F.floor(offset + position * rate)
    return F.least(crossed, F.ceil(rate)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, splits: int = 64, offsets: int = 16, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``carry`` columns, source, size, source_size, target, copies, taken.

    ``docs`` has doc_id, source and text, or else a column ``size`` instead of the text.
    """
    size = F.col("size").cast("long") if "size" in docs.columns and "text" not in docs.columns else word_count(F.col("text"))
    sized = docs.select(*dict.fromkeys(["doc_id", *carry]), "source", size.alias("size"))
    sized = materialize(sized.withColumn("key", source_key()), "sizes")
    targets = source_targets(sized, weights, cap)

    splits *= 1 + sized.count() // 4_000_000
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    part = F.pmod(ident + F.expr("coalesce(cast(doc_id as bigint), 0) div 64") + F.expr("coalesce(cast(doc_id as bigint), 0) div 4096"), F.lit(splits)).cast("int")
    dealt = sized.withColumns({"class": size_class(F.col("size")), "part": part})
    group = ["key", "class", "part"]
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("doc_id").asc_nulls_first(), "size")) - 1
    placed = materialize(dealt.withColumn("inside", inside), "placed")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    first = F.conv(F.substring(F.md5(F.col("key")), 1, 4), 16, 10).cast("double") / F.lit(65536.0)
    groups = (
        placed.groupBy(*group).agg(F.count("*").alias("n")).withColumn("before", before)
        .join(targets, "key").withColumns({"rate": rate, "first": first})
        .select(*group, "before", "source_size", "target", "rate", "first")
    )
    groups = materialize(groups, "groups")
    positioned = placed.join(groups, group).withColumn("position", F.col("before") + F.col("inside"))
    offset_at = lambda k: F.pmod(F.col("first") + F.lit(k / offsets), F.lit(1.0))
    words = [F.sum(F.col("size") * _copies(F.col("position"), F.col("rate"), offset_at(k))).alias(f"w{k}") for k in range(offsets)]
    tried = positioned.groupBy("key").agg(F.first("first").alias("first"), F.first("target").alias("target"), *words)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("error"), F.lit(k).alias("k")) for k in range(offsets)]))["k"]
    chosen = tried.select("key", F.pmod(F.col("first") + best.cast("double") / F.lit(float(offsets)), F.lit(1.0)).alias("offset"))
    final = placed.join(groups.join(chosen, "key"), group).withColumn("position", F.col("before") + F.col("inside"))
    final = final.withColumn("copies", _copies(F.col("position"), F.col("rate"), F.col("offset")))
    return final.select(*dict.fromkeys(["doc_id", *carry]), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as its copies, with its own columns."""
    columns = docs.columns
    marked = docs.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    counts = mix(marked.select("doc_id", "source", "text", "__row"), carry=("doc_id", "__row"), **options)
    counts = materialize(counts.groupBy("doc_id", "__row").agg(F.sum("copies").alias("__copies")).where("__copies > 0"), "copies")
    one = F.row_number().over(Window.partitionBy("doc_id", "__row").orderBy("doc_id"))  # equal rows: one, with all their copies
    kept = (
        marked.alias("d").join(counts.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.__row") == F.col("c.__row")))
        .select("d.*", "c.__copies").withColumn("__one", one).where("__one = 1")
    )
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])
