"""MinHash near-dedup with bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its word shingles; its sketch is the ``SKETCH`` smallest.
Equal sets are one class, and only classes are compared. Inverted lists of the ``PREFIX`` smallest retained
values give pairs and the overlap that the lists saw; pairs that pass are estimated on the bottom-k sketch
of their union, and those that pass that are confirmed on the full sets. Bounds for overlap and estimate
lie five standard deviations below what a linked pair has, so a link is lost about once in ten million.

Long lists (over ``LONG`` classes: shared passages, large groups of copies) are never turned into pairs.
They are left out of the lists above, which costs nothing for a class that has few values in them. The
other classes ("crowded") are indexed again, among themselves, by more of their sketch: values that are
rare there make pairs as before. Classes whose sketch is mostly made of common values even there meet list by list: a hub, the most central
class of a list, joins most of them, and each class that no hub has joined with the list's largest component
meets all others of the list by its full set. So hardly a pair within a component is looked at, and no pair
across components is left out.

Full sets are worked out where the texts are read, for the documents that some pair asks for: a filter of
a bounded size over their ids goes to the readers, and what passes by chance is joined away.
Shingles are compared as 64-bit hashes; words are hashed through an integer mixer, so that two different
shingles of a pair of documents are taken for one with a chance of some 1e-13.

Cases: null and empty texts have no shingles and are linked with nothing. doc_id names a document: rows
that repeat a doc_id share a component. Rows without doc_id have no component and are kept. Fewer words
than a shingle has count as one shingle. A text of any length is one slice of a batch. Columns of other
names are not read; ``dedup`` hands them on, whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import LEAST_BITS, Rows, Texts, cut, drop, marked, mix64, range_hashes, slices
from gridloom.llm.components import components
from gridloom.shipping import ship

SKETCH, PREFIX, LONG = 64, 16, 64
CROWDED = 4  # common values in a prefix
OFTEN, HALF, MOSTLY = 38, 32, 51  # common values in a sketch; see _crowd_pairs
RARE_PREFIX = 24
HUB_TURNS = 8
MOST_VALUES = 1 << 21  # of the sets of a block of a list
FEW_SETS, COLUMNS, MOST_CELLS = 32, 256, 1 << 22  # see list_links
LEAST_PERCENT = 80  # what the numbers above are made for
_ODD = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Likeness:
    words: int = 5
    percent: int = 80

    def __post_init__(self) -> None:
        if self.words < 1 or not LEAST_PERCENT <= self.percent <= 100:
            raise ValueError(f"words must be positive and percent {LEAST_PERCENT} to 100")

    def least(self, values: int) -> int:
        """Of the smallest values of a linked pair's union, how many at least are in both sets."""
        p = self.percent / 100
        return max(1, math.floor(values * p - 5.2 * math.sqrt(values * p * (1 - p))))

    def linked(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)

    def sizes(self, a, b):
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)


def shingle_sets(texts: Texts, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (as int64)."""
    starts, ends, first = texts.words()
    hashes = range_hashes(texts.data, starts, ends)
    n = len(hashes)
    joined = np.zeros(max(0, n - words + 1), dtype=np.uint64)
    for i in range(words):
        joined = joined * _ODD + hashes[i : n - words + 1 + i]
    joined = mix64(joined).view(np.int64)
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            found.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a) * np.ones(1, np.uint64)
            for h in hashes[a:b]:
                whole = whole * _ODD + h
            found.append(mix64(whole ^ _ODD).view(np.int64))
        else:
            found.append(np.zeros(0, np.int64))
    return found


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))


def _names(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """From doc, text: doc, n, name (a digest of the whole set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(Texts(part.column(1), lower=True), words)
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), _names(sets), _lists([s[:SKETCH] for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "name", "sketch"])

    return rows.mapInArrow(run, "doc bigint, n bigint, name binary, sketch array<bigint>")


def _full_sets(rows: DataFrame, words: int, asked: DataFrame) -> DataFrame:
    """From doc, text: doc, name, shingles of the documents in asked, and of some more."""
    spark = rows.sparkSession
    bits, maps = marked(asked, "doc")
    held = np.zeros(bits // 8, dtype=np.uint8)
    for row in maps.toLocalIterator():
        held[row.k * LEAST_BITS // 8 :][: LEAST_BITS // 8] = np.frombuffer(bytes(row.map), np.uint8)
    shared = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            at = np.asarray(batch.column(2))
            batch = batch.filter(pa.array(held[at >> 3] >> (at & 7) & 1 == 1))
            for part in slices(batch, "text"):
                sets = shingle_sets(Texts(part.column(1), lower=True), words)
                yield pa.RecordBatch.from_arrays([part.column(0), _names(sets), _lists(sets)], names=["doc", "name", "shingles"])

    return rows.withColumn("bit", F.pmod(F.xxhash64("doc"), F.lit(bits))).mapInArrow(run, "doc bigint, name binary, shingles array<bigint>")


def _pairs(lists: DataFrame, like: Likeness) -> DataFrame:
    """All pairs a < b of lists (v, doc, n) that are long enough for each other, one row per shared value."""
    left = lists.select("v", F.col("doc").alias("a"), F.col("n").alias("na"))
    right = lists.select("v", F.col("doc").alias("b"), F.col("n").alias("nb"))
    return left.join(right, "v").where((F.col("a") < F.col("b")) & like.sizes(F.col("na"), F.col("nb")))


def _with_counts(lists: DataFrame) -> DataFrame:
    """lists (v, ...) with c, the length of each list; lists of one are dropped."""
    lengths = cut(lists.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), few=True)
    return cut(lists.join(lengths, "v"), lengths)


def _enough(sa, sb, like: Likeness):
    """Whether the sketch of two sets' union holds enough common values: of the smallest values of both
    sketches together, count those in both. What both sketches have in common altogether bounds that, and is
    looked at first."""
    both = F.array_intersect(sa, sb)
    bound = F.size(both) * SKETCH >= like.least(SKETCH) * F.greatest(F.size(sa), F.size(sb))
    union = F.slice(F.sort_array(F.array_union(sa, sb)), 1, SKETCH)
    return F.when(bound, F.size(F.array_intersect(union, both)) * SKETCH >= like.least(SKETCH) * F.size(union)).otherwise(False)


def _estimated(pairs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) whose estimate is high enough."""
    one = classes.select(F.col("doc").alias("a"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("doc").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(one, "a").join(two, "b").where(_enough("sa", "sb", like)).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("xa"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    joined = pairs.join(one, "a").join(two, "b").withColumn("both", both)
    return joined.where(like.linked(F.col("both"), F.size("xa"), F.size("xb"))).select("a", "b").distinct()


def _crowd_pairs(classes: DataFrame, crowded: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """(pairs of crowded classes by rare values, lists (v, doc, n, weight) of common values of those that hubs
    join); weight: how common a class's values are altogether."""
    full = classes.join(crowded, "doc").select("doc", "n", F.posexplode("sketch").alias("pos", "v"))
    lists = _with_counts(full)
    of_doc = W.partitionBy("doc")
    # common values are counted per SKETCH values, so that sets smaller than a sketch count alike
    share = F.count(F.when(F.col("c") > LONG, 1)).over(of_doc) * SKETCH / F.least(F.col("n"), F.lit(SKETCH))
    weight = F.sum(F.when(F.col("c") > LONG, F.col("c"))).over(of_doc)
    rank = F.row_number().over(W.partitionBy("doc", F.col("c") > LONG).orderBy("pos"))
    marked = cut(lists.withColumns({"share": share, "weight": weight, "rank": rank}))
    # a linked pair shares a value that is rare: one of the first ones, if at most OFTEN values of a sketch are
    # common; any, if the sketch is the whole set and less than MOSTLY (80 percent) of it is common
    whole = F.col("n") <= SKETCH
    most = F.when(~whole & (F.col("share") <= OFTEN), RARE_PREFIX).otherwise(SKETCH)
    rare = marked.where((F.col("c") <= LONG) & (F.col("rank") <= most))
    hubs = marked.where((F.col("c") > LONG) & (F.col("rank") <= PREFIX) & (F.col("share") >= F.when(whole, MOSTLY).otherwise(HALF)))
    return _pairs(rare.select("v", "doc", "n"), like).select("a", "b").distinct(), hubs.select("v", "doc", "n", "weight")


def _hub_links(lists: DataFrame, links: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """links with those between classes of the lists (v, doc, n, weight) added.

    A list is one group of rows up to ``MOST_VALUES`` values. A longer one is dealt out to blocks of about that
    size, and every two blocks meet in a group of their own, so that no task holds more than two of them."""
    if lists.isEmpty():
        return links
    sizes = lists.groupBy("v").agg(F.ceil(F.sum("n") / MOST_VALUES).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))
    groups = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(others, lambda x: F.least(x, F.col("block")).cast("long") * F.col("blocks") + F.greatest(x, F.col("block")))
    )
    dealt = lists.join(sizes, "v").withColumn("block", block).select("v", "doc", "weight", F.explode(groups).alias("part"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        shingles = group.column("shingles").combine_chunks()
        offsets = np.asarray(shingles.offsets).astype(np.int64)
        docs, weight = np.asarray(group.column("doc")), np.asarray(group.column("weight"))
        a, b = list_links(docs, weight, offsets - offsets[0], np.asarray(shingles.flatten()), like)
        return pa.table({"a": pa.array(np.minimum(docs[a], docs[b]), pa.int64()), "b": pa.array(np.maximum(docs[a], docs[b]), pa.int64())})

    met = dealt.join(sets, "doc").select("v", "part", "doc", "weight", "shingles").groupBy("v", "part").applyInArrow(run, "a bigint, b bigint")
    return cut(links.unionByName(met), links)


def list_links(docs: np.ndarray, weight: np.ndarray, offsets: np.ndarray, values: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Places a, b of links between the sets values[offsets[i]:offsets[i + 1]] that join what all links join.

    Members of a large group of near copies differ from its centre in places of their own, so that what is
    linked with any other member is, as a rule, linked with the most central one, whose values are the most
    common (weight). So the most central sets outside the largest component meet all others first; then every
    set still outside it meets all others. Whole sets are counted: common values by products of 0/1 matrices,
    rare ones by their lists."""
    m, sizes = len(docs), np.diff(offsets)
    owner = np.repeat(np.arange(m), sizes)
    _, name, count = np.unique(values, return_inverse=True, return_counts=True)
    comp = np.arange(m)
    found: list[tuple[int, int]] = []

    def linked(both: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return like.linked(both.astype(np.int64), sizes[rows][:, None], sizes[None, :])

    def join(i: int, near: np.ndarray) -> None:
        for j in near[np.unique(comp[near], return_index=True)[1]].tolist():
            if comp[i] != comp[j]:
                found.append((i, j))
                comp[comp == comp[j]] = comp[i]

    def rest() -> np.ndarray:
        return np.flatnonzero(comp != np.bincount(comp).argmax())

    order = np.lexsort((docs, weight))[::-1]
    for turn in range(HUB_TURNS):
        outside = order if turn == 0 else order[comp[order] != np.bincount(comp).argmax()]
        if len(outside):
            hub = int(outside[0])
            own = np.zeros(len(count), dtype=bool)
            own[name[offsets[hub] : offsets[hub + 1]]] = True
            join(hub, np.flatnonzero(linked(np.bincount(owner, own[name], m)[None, :], np.array([hub]))[0]))
            order = order[order != hub]  # it has met all others
    left = rest()
    if not len(left):
        return _places(found)
    # rare values: the sets that hold each one; common ones: their column in the matrices
    rare = np.flatnonzero((count[name] > 1) & (count[name] <= FEW_SETS))
    by_name = rare[np.argsort(name[rare], kind="stable")]
    holders, begins = owner[by_name], np.searchsorted(name[by_name], np.arange(len(count)))
    often = np.flatnonzero(count > FEW_SETS)
    column = np.full(len(count), -1)
    column[often] = np.arange(len(often))
    dense = np.flatnonzero(column[name] >= 0)
    dense = dense[np.argsort(column[name[dense]], kind="stable")]
    at_column, at_owner = column[name[dense]], owner[dense]
    step = max(1, MOST_CELLS // m)
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        both = np.zeros((len(rows), m), dtype=np.float32)
        for c in range(0, len(often), COLUMNS):
            x, y = np.searchsorted(at_column, [c, c + COLUMNS])
            held = np.zeros((m, COLUMNS), dtype=np.float32)
            held[at_owner[x:y], at_column[x:y] - c] = 1
            both += held[rows] @ held.T
        flat = both.reshape(-1)
        for i, row in enumerate(rows.tolist()):
            mine = name[offsets[row] : offsets[row + 1]]
            mine = mine[(count[mine] > 1) & (count[mine] <= FEW_SETS)]
            if len(mine):
                lengths = count[mine]
                places = np.repeat(begins[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                flat[i * m : (i + 1) * m] += np.bincount(holders[places], minlength=m)
        near = linked(both, rows) & (comp[rows][:, None] != comp[None, :])
        for i in np.flatnonzero(near.any(1)).tolist():
            join(int(rows[i]), np.flatnonzero(near[i]))
    return _places(found)


def _places(found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def links(docs: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """(doc, n, leader: smallest doc with the same set), (a, b): links between leaders of different sets."""
    ship(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where(F.col("doc_id").isNotNull())
    base = cut(_sketches(named, like.words))
    leaders = cut(base.where("n > 0").groupBy("name").agg(F.min("doc").alias("leader")), few=True)
    members = cut(base.select("doc", "n", "name").join(leaders, "name", "left").select("doc", "n", "name", F.coalesce("leader", "doc").alias("leader")), leaders)
    own = members.where("doc = leader and n > 0").select("doc", "name").distinct()
    classes = cut(base.join(own, ["doc", "name"]).select("doc", "n", "name", "sketch").dropDuplicates(["doc", "name"]), base)

    lists = _with_counts(classes.select("doc", "n", F.explode(F.slice("sketch", 1, PREFIX)).alias("v")))
    common = cut(lists.where(F.col("c") > LONG).groupBy("doc").agg(F.count(F.lit(1)).alias("common")), few=True)
    seen = _pairs(lists.where(F.col("c") <= LONG), like).groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"), F.greatest(F.first("na"), F.first("nb")).alias("n"))
    ca, cb = (common.select(F.col("doc").alias(x), F.col("common").alias("c" + x)) for x in "ab")
    unseen = F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0)))
    needed = F.least(F.lit(like.least(PREFIX)), F.ceil(F.col("n") * like.percent / 100)) - unseen
    met = seen.join(ca, "a", "left").join(cb, "b", "left").where(F.col("overlap") >= needed).select("a", "b")
    # sets with fewer values than a prefix are crowded at the same share of them
    sizes = classes.select("doc", "n").groupBy("doc").agg(F.min("n").alias("n"))
    crowded = cut(common.join(sizes, "doc").where(F.col("common") * PREFIX >= CROWDED * F.least(F.col("n"), F.lit(PREFIX))).select("doc"), few=True)
    crowded_pairs, hub_lists = _crowd_pairs(classes, crowded, like)
    hub_lists = cut(hub_lists)
    pairs = cut(_estimated(met.unionByName(crowded_pairs).distinct(), classes, like), lists, common, crowded)
    asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc")).unionByName(hub_lists.select("doc")).distinct(), few=True)
    sets = cut(_full_sets(named, like.words, asked).join(asked, "doc", "left_semi").dropDuplicates(["doc", "name"]).select("doc", "shingles"), asked)
    found = _hub_links(hub_lists, cut(_confirmed(pairs, sets, like), pairs), sets, like)
    drop(sets, classes, hub_lists)
    repeated = members.where("n > 0").groupBy("doc").agg(F.min("leader").alias("b"), F.max("leader").alias("most")).where("b < most")
    same = members.join(repeated, "doc").select(F.col("leader").alias("a"), "b")
    return members, found.unionByName(same)


def near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id, kept for every row."""
    members, edges = links(docs, like)
    roots = cut(components(edges))
    placed = members.join(roots, members["leader"] == roots["node"], "left").select("doc", "n", F.coalesce("root", "leader").alias("component"))
    missing = docs.where(F.col("doc_id").isNull()).select("text")
    alone = _sketches(missing.select(F.lit(None).cast("long").alias("doc"), "text"), like.words).select("doc", "n", F.lit(None).cast("long").alias("component"))
    every = placed.unionByName(alone)
    return every.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"),
    )


def dedup(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:  # noqa: B008
    """One document of each group, with the columns of docs: the one with the smallest doc_id."""
    rows = Rows(docs, ("doc_id", "text"))
    found = near_duplicates(rows.df.select(rows.col("doc_id").alias("doc_id"), rows.col("text").alias("text")), like)
    dropped = cut(found.where(~F.col("kept")).select(F.col("doc_id").alias("dropped")).distinct())
    return rows.df.join(dropped, rows.col("doc_id") == F.col("dropped"), "left_anti").select(*rows.back())


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), Likeness(words=4))
