"""What the operators share: the folder that all machines see, Arrow batches as numpy arrays, words and their hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, found for a whole Arrow batch at once.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import ship

WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1, _M2, _R, _W, _V = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
#: A random number for each byte at each of a word's first places.
_PLACES = 32
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, _PLACES * 256, np.uint64)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "2m"
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below that which spark.checkpoint.dir names; it goes when the application ends.

    Where the setting is unset, a folder of this machine serves a local master; on a cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not where:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="cloakwork-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        _folders[app] = f"{where.rstrip('/')}/cloakwork-{app}"
        fs, path = _hadoop(spark, _folders[app])
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _folders[app]


def _hadoop(spark: SparkSession, where: str):
    """The file system of a path or URI, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here, and a lost executor loses nothing of it.

    Spark deletes the write's shuffle files as soon as it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def drop(*cuts: DataFrame) -> None:
    """Deletes what cut wrote; nothing may read it any more."""
    for df in cuts:
        fs, path = _hadoop(df.sparkSession, df.cut_path)
        fs.delete(path, True)


def scan_partitions(df: DataFrame) -> int:
    """Number of partitions in which df is read, which follows the bytes of its files."""
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


def pieces(batches, most: int = 1 << 20, rows: int = 1024):
    """The batches' rows in slices of about `most` bytes: Spark bounds a batch by 64 MB, what is made of one here is many times its size."""
    for b in batches:
        if b.nbytes <= most and len(b) <= rows:
            yield b
            continue
        size = sum((_sizes(c) for c in b.columns), np.zeros(len(b), np.int64))
        at = 0
        total = np.cumsum(size)
        while at < len(b):
            last = min(at + rows, max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))))
            yield b.slice(at, last - at)
            at = last


def _sizes(column: pa.Array) -> np.ndarray:
    """Each row's bytes, of columns of strings and bytes; others count as 8."""
    kind = pa.types
    if any(f(column.type) for f in (kind.is_string, kind.is_binary, kind.is_large_string, kind.is_large_binary)):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
    return np.full(len(column), 8, np.int64)


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow over batches of bounded bytes and rows; the package goes along to workers that lack it.

    A session that leaves the bytes of a batch at Spark's default gets BATCH, as both sides hold a batch more than once.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)

    def run(batches):
        try:
            yield from fn(pieces(batches))
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns what a worker no longer uses to the system, as the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass


def texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The id, the text and further columns alone, under fixed names: other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(c) for c in more])


def row_hashes(docs: DataFrame, id_col: str, text_col: str) -> list:
    """h1, h2: 128 bits of a row, from all its columns."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return [F.xxhash64(F.lit(k), F.col(id_col).cast("long"), F.col(text_col).cast("string"), every).alias(f"h{k}") for k in (1, 2)]


def first_of(members: DataFrame) -> DataFrame:
    """h1, h2 of one row for each value of root: that with the smallest doc_id (nulls last), then the smallest hashes."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("first")
    return members.groupBy("root").agg(least).select("first.h1", "first.h2")


def picked(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, all columns, whose h1 and h2 are chosen; of rows that are equal in all columns, one."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_hashes(docs, id_col, text_col))
    found = rows.join(chosen, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def raw(column: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its rows' limits in them; null: empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    limits = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[limits[0] : limits[-1]] if data is not None and limits[-1] > limits[0] else np.zeros(0, np.uint8)
    return flat, limits - limits[0]


def word_spans(flat: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of its first word (one more entry than rows)."""
    inside = ~_SPACE[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[limits] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(flat) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(flat) else inside
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, limits)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """64 bits of each word: the sum of a random number for each byte at its place, or XXH64 of a word over 32 bytes.

    Unlike a polynomial's, its collisions don't depend on how words are made. at_once: bytes of words looked at together.
    """
    size = ends - starts
    out = np.zeros(len(size), np.uint64)
    long_ = np.flatnonzero(size > _PLACES)
    for k in long_.tolist():
        out[k] = xxhash.xxh64_intdigest(flat[starts[k] : ends[k]].tobytes(), 7)
    short = np.flatnonzero(size <= _PLACES) if len(long_) else None
    total, k = np.cumsum(size if short is None else size[short]), 0
    while k < len(total):
        last = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + at_once, "right")))
        which = slice(k, last) if short is None else short[k:last]
        some = size[which]
        first = np.cumsum(some) - some
        within = np.arange(int(some.sum())) - np.repeat(first, some)
        out[which] = np.add.reduceat(_TABLE[(within << 8) | flat[np.repeat(starts[which], some) + within]], first)
        k = last
    return out


def window_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes (modulo 2^64, bits spread) of all windows of width words within a row: hashes, each one's first word, each one's row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _W + words[k : k + n]
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    whole = np.flatnonzero(row[:n] == row[width - 1 :])
    return mix(total[whole]), whole, row[whole]


def window_checks(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """32 further bits of each window that starts at one of first: another polynomial, of other hashes of the same words."""
    if not len(first):
        return np.zeros(0, np.uint32)
    other, n = mix(words ^ _R), len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _V + other[k : k + n]
    return (mix(total[first]) >> np.uint64(32)).astype(np.uint32)


def covered(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of width words that starts at one of first."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + width, -1)
    return np.cumsum(steps[:-1]) > 0
