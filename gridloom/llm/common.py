"""Shared helpers: words and hashes of whole Arrow batches, lineage cuts, column names.

Words are runs of ``[^\\x20\\x09-\\x0D]`` over UTF-8 bytes. Hashes take a word's bytes eight at a time
through a 64-bit integer mixer, for a whole batch with numpy; long ranges are digested one by one.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.shipping import ship

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UPPER_SQL, LOWER_SQL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_SQL = r"[^\x20\x09-\x0D]+"

LONG_RANGE = 64  # bytes from which a range is digested on its own
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)  # the first k bytes of eight


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gridloom-checkpoint-")
        sc.setCheckpointDir(named)
    return named


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame, *gone: DataFrame, by: str | None = None, few: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lost executors cost no recomputation
    beyond this point, and every reader sees the same rows. Its shuffle files go when it is written, the
    tables ``gone`` (cut before, read no more) after that, the table itself when the driver ends or it is
    gone in turn. by: a column to partition the table by. few: the table is small beside its shuffles, and
    several of their partitions go to one file, since many small files cost more than what is in them."""
    spark = df.sparkSession
    if few:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_table = path
    drop(*gone)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_gridloom_table", None):
            remove(table.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of fewer rows for what runs inside, where a worker needs its memory for other things."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


KEPT: dict[str, dict] = {}  # what operators keep in a Python worker from one task to the next, by operator


def make_room(owner: str = "") -> None:
    """In a worker, at the start of a task: what operators other than owner keep there goes, and the memory that
    this and earlier tasks have freed returns to the system."""
    for name, kept in KEPT.items():
        if name != owner:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library of another kind
        ctypes.CDLL(None).malloc_trim(0)


LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27  # of a filter over ids; a bitmap of Spark's has 2^15


def marked(ids: DataFrame, column: str) -> tuple[int, DataFrame]:
    """(bits, table of k, map): a filter over ids of a counted size, ``MOST_BITS`` at most, in maps of 2^15 bits.
    An id's bit is its xxhash64 modulo bits. What has its bit set may be among the ids; nothing else is."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))
    bit = ids.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("bit"))
    return bits, bit.groupBy(F.expr(f"bit div {LEAST_BITS}").alias("k")).agg(F.bitmap_construct_agg(F.expr(f"bit % {LEAST_BITS}")).alias("map"))


def among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows whose column stands in ids (distinct rows of that column and others): joined are only those that a
    filter of a bounded size, which is broadcast, lets through."""
    bits, maps = marked(ids, column)
    maps = maps.select(F.col("k").alias("_k"), F.col("map").alias("_map"))
    marks = rows.withColumn("_bit", F.pmod(F.xxhash64(column), F.lit(bits))).withColumn("_k", F.expr(f"_bit div {LEAST_BITS}"))
    byte = F.conv(F.hex(F.expr(f"substring(_map, cast(_bit % {LEAST_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return marks.join(F.broadcast(maps), "_k").where(there).select(*rows.columns).join(ids, column)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if the session still runs."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def lower_ascii(column):
    return F.translate(column, UPPER_SQL, LOWER_SQL)


def crc_mod(column, m: int):
    """crc32 of the id written as text, mod m; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % m


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte, the eight bytes from there on as one integer; zeros follow the last one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[s:e] for each range. Ranges of up to eight bytes have no equal hashes by length."""
    lengths = ends - starts
    out = mix64(lengths.astype(np.uint64) + _SPREAD)
    ahead = eights(data)
    todo = np.flatnonzero((lengths > 0) & (lengths <= LONG_RANGE))
    at, left = starts[todo], lengths[todo]
    while len(todo):
        out[todo] = mix64(out[todo] ^ (ahead[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(lengths > LONG_RANGE)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        digests = [hashlib.blake2b(view[s:e], digest_size=8).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        out[long] = np.frombuffer(b"".join(digests), dtype=np.uint64)
    return out


def equal_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the bytes of each range equal those of the range that ``other`` numbers."""
    lengths = ends - starts
    same = lengths == lengths[other]
    ahead = eights(data)
    todo = np.flatnonzero(same & (other != np.arange(len(starts))) & (lengths > 0) & (lengths <= LONG_RANGE))
    at, to, left = starts[todo], starts[other[todo]], lengths[todo]
    while len(todo):
        differ = (ahead[at] ^ ahead[to]) & _FIRST[np.minimum(left, 8)] != 0
        same[todo[differ]] = False
        more = ~differ & (left > 8)
        todo, at, to, left = todo[more], at[more] + 8, to[more] + 8, left[more] - 8
    for i in np.flatnonzero(same & (other != np.arange(len(starts))) & (lengths > LONG_RANGE)).tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], data[starts[other[i]] : ends[other[i]]])
    return same


def range_classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the first range of each class, the class of each range): two ranges are in one class if and only if
    their bytes, and their kinds, are the same. Hashes find equal ranges, and bytes confirm them."""
    hashes = range_hashes(data, starts, ends)
    if kind is not None:
        hashes = mix64(hashes + kind.astype(np.uint64))
    _, first, name = np.unique(hashes, return_index=True, return_inverse=True)
    other = first[name]
    same = equal_ranges(data, starts, ends, other)
    if kind is not None:
        same &= kind == kind[other]
    if not same.all():  # two texts under one hash
        kept: dict[tuple, int] = {}
        more = []
        for i in np.flatnonzero(~same).tolist():
            own = (data[starts[i] : ends[i]].tobytes(), 0 if kind is None else int(kind[i]))
            if own not in kept:
                kept[own] = len(first) + len(more)
                more.append(i)
            name[i] = kept[own]
        first = np.concatenate([first, more])
    return first, name


def range_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """An integer for each range; two are the same if and only if the bytes are."""
    return range_classes(data, starts, ends)[1]


class Texts:
    """The texts of a slice of an Arrow column as one byte buffer; null counts as empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_binary()).fill_null(b"")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        data = data[offsets[0] : offsets[-1]]
        self.data = LOWER[data] if lower else data
        self.n = n

    def bounds(self) -> np.ndarray:
        """True at the first byte of each text that has one."""
        first = np.zeros(len(self.data) + 1, dtype=bool)
        first[self.offsets] = True
        return first

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends of all words, and for each text the index of its first word (n + 1 entries)."""
        size = len(self.data)
        if not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        solid, first = ~SPACE[self.data], self.bounds()
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:size]
        stops = solid.copy()
        stops[:-1] &= ~solid[1:] | first[1:size]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return starts, ends, np.searchsorted(starts, self.offsets, side="left")

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends of all \\n-split lines (every text has one at least), and each text's first line."""
        breaks = np.flatnonzero(self.data == 10)
        # a line begins at each text's start and after each \n; a line ends at each \n and each text's end
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([self.offsets[1:], breaks])
        owner_s = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, breaks, side="right") - 1])
        owner_e = owner_s
        order_s, order_e = np.lexsort((starts, owner_s)), np.lexsort((ends, owner_e))
        counts = np.bincount(owner_s, minlength=self.n)
        return starts[order_s], ends[order_e], np.concatenate([[0], np.cumsum(counts)])


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; one text is never split."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0))
    part = np.cumsum(lengths) // most
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


#: Plans whose rows are rows of the files themselves.
_PLAIN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def _straight(plan) -> bool:
    below = plan.children()
    return plan.nodeName() in _PLAIN and plan.deterministic() and all(_straight(below.apply(i)) for i in range(below.size()))


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a row key: a row's file and its place there, which are the same in every reading, however
    the files are dealt to tasks. What is not read straight from Parquet files is written first."""
    ship(docs.sparkSession)
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if _straight(docs._jdf.queryExecution().analyzed()):
        try:
            return docs.withColumn(name, place)
        except AnalysisException:  # files of a kind that does not number its rows
            pass
    return cut(docs).withColumn(name, place)


class Rows:
    """docs with its columns renamed ``doc_0 ...`` and a row key ``rid``, so that an operator's own names
    never clash with them."""

    def __init__(self, docs: DataFrame, needed: tuple[str, ...]):
        missing = [c for c in needed if c not in docs.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        self.columns = docs.columns
        self.inner = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
        self.df = keyed(docs.toDF(*self.inner.values()), "rid")

    def col(self, name: str):
        return F.col(self.inner[name])

    def back(self, own: tuple[str, ...] = ()) -> list:
        """The columns of docs under their own names, without those that the operator returns itself."""
        return [F.col(self.inner[c]).alias(c) for c in self.columns if c not in own]
