"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word shingles. Two sets of Jaccard similarity num/den or
more differ in at most d = floor(size * (den - num) / num) elements, by the size of either.

Parts. Shingles are dealt to p parts by hash, and each part's key keeps the parity (XOR) of its shingles'
hashes. One differing shingle changes one part at most, so two sets that link agree in p - d parts. Sizes are
banded so that both use the same p; a set within reach of the band below is sent there too.

Pigeonhole, in its prefix form. Whatever order is put on keys, two sets that link share one of the first d + 1
keys that each has, d by its own size, if only parts that hold shingles count and there are more than d of
those; the few sets with fewer send keys of empty parts, too. The order here is the number of sets with the
key, rarest first: a key that one set has can match nothing and takes up a place, so most sets send few keys or
none, and the key of a passage that very many sets share is sent by those only whose other keys don't suffice.

Sketches. Two sets that share a key need sizes in reach and a Hamming distance of at most d between parity
sketches (each shingle flips one bit, so that distance is a lower bound of the number of differing shingles; the
bits follow d, 1,024 at least, and longer sketches fold to shorter ones), and last the exact count of common shingles.

Classes. Equal sets are one node. Among those that share a key, each is compared with one hub, so a group of
n costs n comparisons; connected components follow from the links found. Where the members of a key still lie
in different components, pairs across these are compared by sketches in memory, and of those that may link
only the nearest that make a spanning forest over the components are put out and counted. Members of a key's
largest component are not compared with each other, so a large group with few strays costs few rows. That is
repeated once, with pairs that a key put out before left out. Members that may still link then are put out as a
spanning forest over the members; its trees, those of all keys taken together, are groups whose members meet with
their shingles, all pairs that may link are counted in memory, and a spanning forest of the links found comes out.
So each step puts out fewer rows than it reads members, however many pairs may link and fail: no group is expanded
into its pairs, and no link between components is lost. A key of n sets that are all of different components moves
n * n / BLOCK_ROWS rows of sketches; the order of keys makes such keys rare.

Empty and null texts have no shingles and link with nothing. Equal rows are members of one class; a null
doc_id never names a class that has others. Extra columns are not read; an empty table gives an empty table.
Very long texts are one row of one batch, and their keys and sketches follow their size.
Shingles are told apart by 64-bit hashes, sets by 128 bits: a pair of 64-bit names of which the first is used
for joins once it is checked to be unique.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, bounded_batches, materialize, release, scratch

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
SKETCH_BITS, SKETCH_FACTOR = 1024, 8
#: A set of sids up to this many rows (16 bytes each) may be broadcast to filter a scan.
BROADCAST_ROWS = 500_000
#: Spanning forests of pairs that are counted in a unit's first and second round; then pairs, this many times its members.
FORESTS, MOST_PAIRS = (1, 1), 512
#: Rows and bytes of sketches of a block, two of which meet in memory, and bytes of what one task gets at a time.
BLOCK_ROWS, BLOCK_BYTES, BUCKET_BYTES = 1_024, 8 << 20, 2 << 20
NOT_FOUND = "a document of the table was not found again"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _new(x: np.ndarray) -> np.ndarray:
    """Where a sorted array, not empty, has another value than before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z; fewer words make one shingle."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * _M3 + h[i : len(h) - width + 1 + i])
    out.sort()
    return out[_new(out)]


def bands(ratio: float = 1.5, most: int = 1 << 40) -> list[int]:
    """Lower ends of the size bands."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


_BANDS = bands()
_BAND_ARRAY = np.array(_BANDS)


def differing(size: int, num: int, den: int) -> int:
    return size * (den - num) // num


def part_count(most_differing: int) -> int:
    """Parts of a band: some more than may differ, so that nearly every set has more parts with shingles than that."""
    return (most_differing + 1) * 108 // 100 + 5


def part_keys(u: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, int]]:
    """(keys, spare) for the set's own band and, if a link can reach it, the band below (else no keys).

    Of the keys in any common order all but the last ``spare`` must be sent.
    """
    size, mixed = len(u), mix(u)
    d = differing(size, num, den)
    own = int(np.searchsorted(_BAND_ARRAY, size, "right")) - 1
    out = []
    for band in (own, own - 1):
        if d == 0 or band < 0 or (band < own and (_BANDS[own] - 1) * den < num * size):
            out.append((np.empty(0, np.uint64), 0))  # d == 0: only equal sets link
            continue
        parts = part_count(differing(_BANDS[band + 1] - 1, num, den))
        at = ((u >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with u
        starts = np.flatnonzero(_new(at))
        place = lambda part: mix(part + np.uint64((band + 1) << 40)) * _M3
        keys = mix(np.bitwise_xor.reduceat(mixed, starts) + place(at[starts]))
        spare = len(keys) - d - 1
        if spare < 0:  # empty parts agree, too; they stand last in the order
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), at[starts])
            keys, spare = np.r_[keys, np.sort(mix(place(empty)))[:-spare]], 0
        out.append((keys, spare))
    return out


def sketch_bits(size: int, num: int, den: int) -> int:
    """A power of two, about SKETCH_FACTOR to twice that many bits for each element that may differ."""
    return max(SKETCH_BITS, 1 << (SKETCH_FACTOR * differing(size, num, den)).bit_length())


def sketch(u: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the shingles at each of ``bits`` positions, as 64-bit words; XOR of its halves is the sketch of half the bits."""
    odd = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fold(words: np.ndarray, length: int) -> np.ndarray:
    """The sketch with ``length`` words."""
    while len(words) > length:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def name_of(u: np.ndarray) -> tuple[int, int]:
    """The set's name, 128 bits as two signed integers: the XOR and the sum of scrambled hashes, with the size."""
    size, mixed = np.array([len(u)], np.uint64), mix(u * _M2 + np.uint64(1))
    low = mix(np.array([np.bitwise_xor.reduce(mixed)]) + size * _M3)
    high = mix(np.array([np.add.reduce(mixed)]) + size * _M2)
    return int(low.view(np.int64)[0]), int(high.view(np.int64)[0])


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")


_DESCRIBED = "doc_id long, hash long, n long, sid long, high long, sketch array<long>, keys array<long>, own int, spare_own int, spare_below int"


def described(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, hash of the text, n, sid, high, sketch, keys, own, spare_own, spare_below) of each row.

    The first ``own`` keys are those of the set's own band, the others those of the band below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, low, high, marks, keys, rest = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                u = shingle_set(text, words)
                (a, spare_a), (b, spare_b) = part_keys(u, num, den) if len(u) else ((u, 0), (u, 0))
                name = name_of(u) if len(u) else (None, None)
                n.append(len(u))
                low.append(name[0])
                high.append(name[1])
                marks.append(sketch(u, sketch_bits(len(u), num, den)) if len(u) else np.empty(0, np.int64))
                keys.append(np.r_[a, b])
                rest.append((len(a), spare_a, spare_b))
            own, spare_own, spare_below = (pa.array([r[i] for r in rest], pa.int32()) for i in range(3))
            names = [c.split(" ")[0] for c in _DESCRIBED.split(", ")]
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), _arrays(marks), _arrays(keys), own, spare_own, spare_below]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _rows(docs).mapInArrow(run, _DESCRIBED)


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, shingles) of the wanted (doc_id, hash, sid, high). Few are broadcast to the scan; many are joined."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side, rows = wanted.select(F.col("doc_id").alias("id"), F.col("hash").alias("text_hash"), "sid", "low", "high"), _rows(docs)
    chosen = rows.join(F.broadcast(side) if few else side, rows["doc_id"].eqNullSafe(F.col("id")) & (rows["hash"] == F.col("text_hash"))).select("sid", "low", "high", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(3).to_pylist()]
            names = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            right = [i for i, (u, s) in enumerate(zip(sets, names, strict=True)) if len(u) and name_of(u) == s]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right, pa.int64())), _arrays([sets[i] for i in right])], names=["sid", "shingles"])

    return chosen.mapInArrow(run, "sid long, shingles array<long>").dropDuplicates(["sid"])


Keep = Callable[[DataFrame, str], DataFrame]


def components(links: DataFrame, keep: Keep = materialize) -> DataFrame:
    """(sid, root) for the nodes of links (a, b): the smallest sid of each connected component.

    Each round takes the least root among neighbours, then the root's root, so long chains shrink by
    doubling. Hubs are plain join keys, whose partitions the engine can split.
    """
    edges = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    roots = keep(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("sid"), F.least("a", "least").alias("root")), "roots")
    while True:
        near = edges.join(roots.select(F.col("sid").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        moved = keep(roots.join(near, roots["sid"] == near["a"]).select("sid", F.least("root", "near").alias("root"), F.col("root").alias("old")), "roots")
        above = moved.select(F.col("sid").alias("root"), F.col("root").alias("top"))
        roots = keep(moved.join(above, "root").select("sid", F.col("top").alias("root"), (F.col("top") != F.col("old")).alias("changed")), "roots")
        if roots.where("changed").isEmpty():
            return roots.select("sid", "root")
        roots = roots.select("sid", "root")


def _plausible(num: int, den: int) -> Column:
    """Whether sizes and parity sketches of the sets x and y allow a link; sizes in reach have sketches within a factor 2."""
    small, large = F.least("nx", "ny"), F.greatest("nx", "ny")
    length = F.least(F.size("kx"), F.size("ky"))
    xor = lambda a, b: a.bitwiseXOR(b)
    short = lambda k: F.when(F.size(k) == length, F.col(k)).otherwise(F.zip_with(F.slice(k, F.lit(1), length), F.slice(k, length + 1, length), xor))
    distance = F.aggregate(F.zip_with(short("kx"), short("ky"), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda s, v: s + v)
    return (small * den >= large * num) & (distance * num <= small * (den - num))


def plausible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of sids whose sketches allow a link."""
    x = nodes.select(F.col("sid").alias("a"), F.col("n").alias("nx"), F.col("sketch").alias("kx"))
    y = nodes.select(F.col("sid").alias("b"), F.col("n").alias("ny"), F.col("sketch").alias("ky"))
    return pairs.join(y, "b").join(x, "a").where(_plausible(num, den)).select("a", "b")


def counted(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of the pairs (a, b), by the exact number of common shingles."""
    sx, sy = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sx")), sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sy"))
    seen = F.col("sx").isNotNull() & F.col("sy").isNotNull()
    common = F.when(seen, F.size(F.array_intersect("sx", "sy"))).otherwise(F.raise_error(F.lit(NOT_FOUND)).cast("int"))
    found = pairs.join(sy, "b", "left").join(sx, "a", "left").withColumn("common", common)
    linked = F.col("common") * den >= (F.size("sx") + F.size("sy") - F.col("common")) * num
    return found.select("a", "b", linked.alias("linked"))


def named_apart(table: DataFrame, keep: Keep) -> DataFrame:
    """``table`` with ``low`` (the first half of the name) and ``sid``: ``low``, but for sets that share it with another.

    Those few take a hash of their whole name.
    """
    several = table.where("n > 0").groupBy("sid").agg(F.min("high").alias("first"), F.max("high").alias("last")).where("first < last")
    several = keep(several.select(F.col("sid").alias("low"), "first"), "clashes")
    plain = table.withColumnRenamed("sid", "low")
    if several.isEmpty():
        return plain.withColumn("sid", F.col("low"))
    other = F.when(F.col("high") != F.col("first"), F.xxhash64("low", "high")).otherwise(F.col("low"))
    table = keep(plain.join(several, "low", "left").withColumn("sid", F.coalesce(other, "low")).drop("first"), "named")
    if not table.where("n > 0").groupBy("sid").agg(F.min("high").alias("first"), F.max("high").alias("last")).where("first < last").isEmpty():
        raise ValueError("the names of three sets clash")
    return table


def shared_keys(table: DataFrame, keep: Scratch) -> DataFrame:
    """(key, sid, hub) of the keys that several sets must send; ``hub`` is the smallest of them. See the module's text.

    Keys are shortened to as many bits as tell nearly all of them apart; where two become one, that adds a candidate,
    and where both are one set's, the set may leave out one key less.
    """
    several = table.where("n > 0")
    total = several.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = min(63, int(total).bit_length() + 7)
    shorter = lambda keys: F.transform(keys, lambda k: k.bitwiseAND(F.lit((1 << bits) - 1)))
    merged = lambda keys: F.size(keys) - F.size(F.array_distinct(keys))
    several = several.select("sid", shorter("keys").alias("keys"), "own", "spare_own", "spare_below")
    left_out = {"spare_own": F.col("spare_own") - merged(F.slice("keys", F.lit(1), F.col("own"))), "spare_below": F.col("spare_below") - merged(F.slice("keys", F.col("own") + 1, F.size("keys")))}
    several = several.withColumns({n: F.greatest(c, F.lit(0)) for n, c in left_out.items()})
    # most keys are one document's: keys alone are counted first, and only rows of the others travel with names
    repeated = keep(several.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"), "repeated")
    release(table.sparkSession)
    spare = F.when(F.col("at") >= F.col("own"), -1 - F.col("spare_below")).otherwise(F.col("spare_own")).alias("spare")  # under 0 in the band below
    sent = several.select("sid", F.posexplode("keys").alias("at", "key"), "own", "spare_own", "spare_below").select("key", "sid", spare)
    again = sent.join(repeated, "key", "left_semi").distinct()
    again = keep(again.select("key", "sid", (F.col("spare") < 0).alias("below"), F.when(F.col("spare") < 0, -1 - F.col("spare")).otherwise(F.col("spare")).alias("spare")), "again")
    keep.drop(repeated)
    held = again.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")  # copies of one set are not several
    rarest = Window.partitionBy("sid", "below")
    ranked = again.join(held, "key").withColumns({"nth": F.row_number().over(rarest.orderBy("sets", "key")), "all": F.count("*").over(rarest)})
    needed = keep(ranked.where("nth <= all - spare").select("key", "sid"), "needed")
    hubs = needed.groupBy("key").agg(F.min("sid").alias("hub"), F.max("sid").alias("last")).where("hub < last").select("key", "hub")
    shared = keep(needed.join(hubs, "key"), "shared")
    keep.drop(again, needed)
    return shared


def classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, hash, n_shingles, sid, root, component_id) of each row; links are similarities of num/den or more.

    ``hash`` is the text's, ``sid`` names the row's set and ``root`` its class; the last two are null without shingles.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with scratch(spark) as keep:
        whole = keep(described(docs, words, num, den), "described")
        table = named_apart(whole, keep)
        shown = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "low", "high")).alias("shown")  # the row that shows the set
        nodes = table.where("n > 0").groupBy("sid").agg(shown, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        nodes = keep(nodes.select("sid", "n", "sketch", F.col("shown.doc_id").alias("rep"), F.col("shown.hash").alias("hash"), "shown.low", "shown.high"), "nodes")
        shared = shared_keys(table, keep)
        table = keep(table.select("doc_id", "hash", "n", "sid"), "rows")
        keep.drop(whole)
        wanted = nodes.join(shared.select("sid").distinct(), "sid").select(F.col("rep").alias("doc_id"), "hash", "sid", "low", "high")
        sets = keep(shingle_sets(docs, keep(wanted, "wanted"), words), "sets")
        release(spark)
        pairs = shared.where("sid != hub").select(F.col("hub").alias("a"), F.col("sid").alias("b")).distinct()
        tested = [keep(counted(keep(plausible(pairs, nodes, num, den), "plausible"), sets, num, den), "tested")]
        earlier: list[tuple[DataFrame, DataFrame]] = []
        for turn in itertools.count():
            known = functools.reduce(DataFrame.unionByName, tested)
            roots = components(known.where("linked"), keep)
            found = keep(open_pairs(shared, roots, nodes, earlier, num, den, turn, keep), "found")
            if found.isEmpty():
                break
            if turn == len(FORESTS):
                tested.append(keep(links_of_groups(found, roots, nodes, sets, num, den, turn, keep), "tested"))
                roots = components(functools.reduce(DataFrame.unionByName, tested).where("linked"), keep)
                break
            earlier.append((roots, keep(found.select("key").distinct(), "open_keys")))
            pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
            tested.append(keep(counted(pairs, sets, num, den), "tested"))
        named = nodes.select("sid", "rep").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        final = keep(named.join(least, "root").select("sid", "root", "component_id"), "classes")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        rows = table.select("doc_id", "hash", "n", "sid").join(final, "sid", "left")
        return materialize(rows.select("doc_id", "hash", F.col("n").alias("n_shingles"), "sid", "root", component.alias("component_id")), "members")


def links_of_groups(found: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame, num: int, den: int, turn: int, keep: Keep) -> DataFrame:
    """(a, b, linked): links that join all components of ``roots`` between which the groups that ``found`` spans have any."""
    groups = components(found.select("a", "b").distinct(), keep).select(F.col("root").alias("key"), "sid", F.col("root").alias("hub"))
    shingles = F.coalesce("shingles", F.raise_error(F.lit(NOT_FOUND)).cast("array<long>")).alias("shingles")
    whole = keep(nodes.join(groups.select("sid"), "sid").join(sets, "sid", "left").select("sid", "n", "sketch", shingles), "whole")
    links = open_pairs(groups, roots, whole, [], num, den, turn, keep)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("linked"))


def open_pairs(shared: DataFrame, roots: DataFrame, nodes: DataFrame, earlier: list[tuple[DataFrame, DataFrame]], num: int, den: int, turn: int, keep: Keep) -> DataFrame:
    """(key, a, b): pairs of different components that share a key and may link, without those that the key put out before.

    After the turns of FORESTS a spanning forest of them over the members. If ``nodes`` have shingles, pairs are counted
    here, and a spanning forest over the components of those that link is returned; nothing was compared with the hub then.

    The members of a key's largest component are passive: they meet active ones only. Active members are dealt to
    the first blocks, passive ones to the rest, and each active block meets every block in one unit, as large as two
    blocks; units are dealt to buckets of about BUCKET_BYTES, so neither a large key nor many small ones fill a task.

    ``earlier`` holds (roots, keys that put out pairs) of the turns before. Members carry their roots of every turn and
    are dealt as in the first, so a unit finds again, in memory, what it put out before; no pairs travel for that.
    """
    exact = "shingles" in nodes.columns
    marks = ["sketch", "shingles"] if exact else ["sketch"]
    length = sum((F.size(c) for c in marks), F.lit(0)).alias("length")
    placed = shared
    for i, found in enumerate([*(r for r, _ in earlier), roots]):
        placed = placed.join(found.select("sid", F.col("root").alias(f"root{i}")), "sid", "left").withColumn(f"root{i}", F.coalesce(f"root{i}", "sid"))
    if earlier:  # a key that put out no pair has none left
        placed = placed.join(earlier[-1][1], "key", "left_semi")
    history = [f"root{i}" for i in range(len(earlier) + 1)]
    placed = keep(placed.select("key", "sid", "hub", F.col(history[0]).alias("root"), F.col(history[-1]).alias("now"), F.array(*history).alias("roots")), "placed")
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("members"), F.min("now").alias("least"), F.max("now").alias("last"))
    total, most = F.sum("members").alias("total"), F.max(F.struct("members", "root")).alias("most")
    open_keys = sizes.groupBy("key").agg(total, most, F.min("least").alias("least"), F.max("last").alias("last")).where("least < last").where(F.lit(exact) | (F.col("total") > 2))  # of two, one is the hub of the other
    open_keys = open_keys.select("key", F.col("most.root").alias("main"), F.col("most.members").alias("passive"), (F.col("total") - F.col("most.members")).alias("active"))
    loaded = keep(placed.join(open_keys, "key").join(nodes.select("sid", "n", length), "sid"), "open")
    longest = loaded.groupBy("key").agg(F.max("length").alias("longest"))
    block_rows = F.greatest(F.lit(16), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("longest"))))).cast("int")
    blocks = lambda n: F.ceil(F.col(n) / F.col("block_rows")).cast("int")
    members = loaded.join(longest, "key").withColumn("block_rows", block_rows).withColumns({"first": blocks("active"), "second": blocks("passive"), "is_main": F.col("root") == F.col("main")})
    dealt = F.when(F.col("is_main"), F.col("first") + F.pmod(F.xxhash64("sid"), F.col("second"))).otherwise(F.pmod(F.xxhash64("sid"), F.col("first"))).cast("int")
    members = keep(members.select("key", "sid", "roots", "hub", "n", "first", "second", "is_main", "length", dealt.alias("block")), "members")
    meets = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("first")).otherwise(F.col("first") + F.col("second")) - 1)
    unit = lambda x, y: {"x": F.least(x, y), "y": F.greatest(x, y), "bucket": F.pmod(F.xxhash64("key", F.least(x, y), F.greatest(x, y)), F.lit(buckets))}
    size = members.agg(F.sum((F.col("length") * 8 + 80 + 8 * len(earlier)) * F.size(meets))).first()[0] or 0
    buckets = max(1, int(size) // BUCKET_BYTES)
    met = members.withColumn("other", F.explode(meets)).withColumns(unit("block", "other")).select("bucket", "key", "x", "y", "sid", "roots", "hub", "n", "block")
    met = met.join(nodes.select("sid", *marks), "sid")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "x", "y", "sid"], kind="stable")
        key, first, second, sid, hub, n, block, sketches, sets = (rows[c].to_numpy() for c in ("key", "x", "y", "sid", "hub", "n", "block", "sketch", marks[-1]))
        roots = np.stack(rows["roots"].to_list(), axis=1)  # one row a turn
        ends = np.flatnonzero((key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
        out = [np.empty((0, 3), np.int64)]
        for low, high in itertools.pairwise([0, *ends.tolist(), len(rows)]):
            at = slice(low, high)
            if (roots[-1, at] == roots[-1, low]).all():
                continue
            pairs = may_link(sid[at], roots[0, at], n[at], list(sketches[at]), block[at], None if exact else hub[low], None, num, den)
            if exact:
                chosen = forest_of_links(sid[at], roots[0, at], list(sets[at]), pairs, num, den)
            elif turn < len(FORESTS):
                chosen = pairs_of_turn(sid[at], roots[:, at], pairs)
            else:
                left = pairs_left(sid[at], roots[:, at], pairs)
                chosen = sid[at][left[spanning_forest(np.arange(high - low), left)]]
            out.append(np.c_[np.full(len(chosen), key[low]), chosen])
        table = np.concatenate(out)
        return pd.DataFrame({"key": table[:, 0], "a": table[:, 1], "b": table[:, 2]})

    return met.groupBy("bucket").applyInPandas(compare, "key long, a long, b long")


def pairs_left(sid: np.ndarray, roots: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Those ``pairs`` of different components in the turn of the last row of ``roots`` that the turns of the rows before did not choose."""
    number = np.array([len(sid), 1])
    for turn, root in enumerate(roots):
        pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
        if turn + 1 < len(roots):
            chosen = np.searchsorted(sid, nearest_pairs(sid, root, pairs, turn))
            pairs = pairs[~np.isin(pairs @ number, chosen @ number)]
    return pairs


def pairs_of_turn(sid: np.ndarray, roots: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """(a, b) that ``nearest_pairs`` chooses in the turn of the last row of ``roots``, of those not chosen in the turns of the rows before."""
    return nearest_pairs(sid, roots[-1], pairs_left(sid, roots, pairs), len(roots) - 1)


def common_shingles(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Numbers of common shingles of the sets at the places (i, j) of ``pairs``."""
    ids, starts = np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum([0, *map(len, sets)])
    of = [ids[low:high] for low, high in itertools.pairwise(starts)]
    has, out = np.zeros(len(ids), bool), np.empty(len(pairs), np.int64)
    order = np.argsort(pairs[:, 0], kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(pairs[order, 0])) + 1):
        first = of[pairs[at[0], 0]]
        has[first] = True
        out[at] = [np.count_nonzero(has[of[j]]) for j in pairs[at, 1]]
        has[first] = False
    return out


def forest_of_links(sid: np.ndarray, root: np.ndarray, sets: list[np.ndarray], pairs: np.ndarray, num: int, den: int) -> np.ndarray:
    """(a, b) of those ``pairs`` of places that link and join components: rounds as in ``classes``, in memory, until no pair is left."""
    place, size, out = np.arange(len(sid)), np.array([len(x) for x in sets]), []
    for turn in itertools.count():
        pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
        if not len(pairs):
            return sid[np.array(out, np.int64).reshape(-1, 2)]
        chosen = nearest_pairs(place, root, pairs, turn)
        both = common_shingles(sets, chosen)
        links = chosen[both * den >= (size[chosen].sum(axis=1) - both) * num]
        for a, b in links[spanning_forest(root, links)].tolist():
            out.append((a, b))
            root = np.where(root == root[b], root[a], root)
        pairs = pairs[~np.isin(pairs @ [len(sid), 1], chosen @ [len(sid), 1])]


def distances(sketches: dict[int, np.ndarray], lengths: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hamming distances of the rows low to high to all rows, each pair at the shorter length of its two, as in ``_plausible``.

    ``sketches`` holds by length, shortest first, the folded sketches of the rows that are as long or longer.
    """
    out = np.zeros((high - low, len(lengths)), np.int32)
    for length, words in sketches.items():
        at = np.flatnonzero(lengths >= length)
        first, last = np.searchsorted(at, (low, high))
        apart = np.zeros((last - first, len(at)), np.int32)
        for w in range(length):
            apart += np.bitwise_count(words[first:last, w][:, None] ^ words[:, w][None])
        out[np.ix_(at[first:last] - low, at)] = apart  # what both have at this length replaces the shorter one's
    return out


def may_link(sid: np.ndarray, root: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], block: np.ndarray, hub: int | None, known: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Places (i, j), i < j, of members of different components that may link, nearest first. ``sid`` is sorted.

    Where members are of two blocks only pairs across them are looked at, as each block meets itself elsewhere.
    The hub, if there is one, was compared with all before; so were the pairs (a, b) in ``known``.
    """
    across, found, apart_of = len(np.unique(block)) > 1, [], []
    lengths = np.array([len(x) for x in sketches])
    folded = {int(k): np.stack([fold(np.asarray(x, np.int64), k) for x in sketches if len(x) >= k]).view(np.uint64) for k in np.unique(lengths)}
    done = np.zeros((len(sid), len(sid)), bool)
    if known is not None:
        i, j = np.searchsorted(sid, known[:, 0]), np.searchsorted(sid, known[:, 1])
        done[i, j] = done[j, i] = True
    if hub is not None:
        done[sid == hub] = True
        done[:, sid == hub] = True
    step = max(1, 262_144 // max(1, len(sid)))  # rows compared with all others at once
    for low in range(0, len(sid), step):
        rows = np.arange(low, min(low + step, len(sid)))
        apart = distances(folded, lengths, low, low + len(rows))
        small, large = np.minimum(n[rows][:, None], n[None]), np.maximum(n[rows][:, None], n[None])
        may = (small * den >= large * num) & (apart * np.int64(num) <= small * (den - num)) & (root[rows][:, None] != root[None]) & (rows[:, None] < np.arange(len(sid))[None]) & ~done[rows]
        if across:
            may &= block[rows][:, None] != block[None]
        i, j = np.nonzero(may)
        found.append(np.c_[i + low, j])
        apart_of.append(apart[i, j])
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return pairs[np.argsort(np.concatenate(apart_of), kind="stable")] if len(pairs) else pairs


def nearest_pairs(sid: np.ndarray, root: np.ndarray, pairs: np.ndarray, turn: int) -> np.ndarray:
    """(a, b) of those ``pairs`` that are counted in this turn: all if they are few; else spanning forests over the
    components that share no pair, each of the nearest pairs that are left; from the third turn on the nearest pairs."""
    forests = FORESTS[turn] if turn < len(FORESTS) else MOST_PAIRS
    most = forests * len(sid)
    if len(pairs) > most and turn < len(FORESTS):
        start, left, out = np.unique(root, return_inverse=True)[1], pairs, []
        for _ in range(forests):
            used = spanning_forest(start, left)
            out.append(left[used])
            left = np.delete(left, used, axis=0)
        pairs = np.concatenate(out)
    pairs = pairs[:most]
    return np.c_[sid[pairs[:, 0]], sid[pairs[:, 1]]].astype(np.int64)


def spanning_forest(start: np.ndarray, pairs: np.ndarray, step: int = 4_096) -> list[int]:
    """Places of those pairs that, taken in order, each join two components; ``start`` is each member's component."""
    label, used = start.copy(), []
    for low in range(0, len(pairs), step):
        i, j = pairs[low : low + step].T
        while (apart := np.flatnonzero(label[i] != label[j])).size:
            k = int(apart[0])
            used.append(low + k)
            label[label == label[j[k]]] = label[i[k]]
            i, j, low = i[k + 1 :], j[k + 1 :], low + k + 1
    return used


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without near duplicates: of each class the row with the smallest doc_id stays, of no-shingle rows all."""
    found = classes(docs, words, num, den)
    rows = found.count()
    if found.select("doc_id").distinct().count() == rows and found.where("doc_id is null").isEmpty():
        gone = found.where("doc_id != component_id").select("doc_id")
        gone = materialize(gone, "gone")
        few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    return _one_of_repeated(docs, found)


def _one_of_repeated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """As ``one_of_each`` where doc_ids repeat or are null: rows are told apart by doc_id and the text's hash."""
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    shown = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")).alias("k")
    kept = found.where("root is not null").groupBy("root").agg(shown).select(F.col("k.doc_id").alias("__id"), F.col("k.hash").alias("__text"))
    marked = docs.withColumn("__hash", F.xxhash64("text"))
    first = F.row_number().over(Window.partitionBy("doc_id", "__hash").orderBy("__hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text"))
    one = marked.where(has_words).join(kept, same).withColumn("__n", first).where("__n = 1")
    return one.select(*docs.columns).unionByName(docs.where(~has_words).select(*docs.columns))
