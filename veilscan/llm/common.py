"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = r"[\x20\x09-\x0D]+"
_own_dir: list[str] = []
_stored: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Only a session whose tasks run in the
    driver's own process may do without, as tests do: a folder of this machine
    takes its place there. On a cluster an unset one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="veilscan-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; it is deleted by ``delete``, or else when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stored[path] = spark
    return path


def delete(path: str) -> None:
    spark = _stored.pop(path)
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark._jsc.hadoopConfiguration()).delete(of, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_stored.items()):
        if spark.sparkContext._jsc is not None:  # a stopped session has no file system to ask
            delete(path)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it: lineage ends there,
    so a lost executor costs nothing that came before."""
    path = own_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``tables``, once nothing that is still to be run reads them."""
    for table in tables:
        delete(table.stored_at)


#: Keys that ``meet`` broadcasts at most, and rows of a key from which it may be one of them.
HOT_KEYS, HOT_ROWS = 100_000, 64


def meet(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", counted: str | None = None) -> DataFrame:
    """``rows`` joined by ``key`` (inner or left) with ``unique``, which has each key once, whatever share of the rows one key holds.

    The ``HOT_KEYS`` keys with most rows, of those with more than ``HOT_ROWS``,
    meet by a broadcast of that many rows at most; no other key brings more than
    one in ``HOT_KEYS`` of the rows to a task. Both tables are read more than
    once, so they should be stored. Rows with a null key meet nothing and stay in
    a left join. If ``unique`` has every key of ``rows`` and knows how many of them
    each has, ``counted`` names that column, and they are not counted again.
    """
    none, rows = rows.filter(F.col(key).isNull()), rows.filter(F.col(key).isNotNull())
    # in a total order, so that both joins see the same keys
    if counted is None:
        hot = rows.groupBy(key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > HOT_ROWS).orderBy(F.desc("_rows"), key).limit(HOT_KEYS).select(key)
        known = hot.join(unique, key, how)
    else:
        known = unique.filter(F.col(counted) > HOT_ROWS).orderBy(F.desc(counted), key).limit(HOT_KEYS)
        hot = known.select(key)
    out = rows.join(F.broadcast(hot), key, "left_anti").join(unique, key, how)
    out = rows.join(F.broadcast(known), key).select(*out.columns).unionByName(out)
    return out.unionByName(none, allowMissingColumns=True) if how == "left" else out


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``most`` words in each worker."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence if it is shorter."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + mixed(word_hashes[i : n - k + 1 + i])
    return mixed(out)


def tidy(f):
    """For what runs on batches: when a task ends, its worker gives back the memory that allocators keep. Workers live on between tasks, beside others."""

    @functools.wraps(f)
    def run(*args, **how):
        try:
            yield from f(*args, **how)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``most_bytes`` of ``column``; a longer row is a slice of its own."""
    for batch in batches:
        sizes = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
