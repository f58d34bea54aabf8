"""What the operators share: tables in the shared folder, checked broadcasts, sharding, byte-level words."""

from __future__ import annotations

import atexit
import itertools
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_WRITTEN = itertools.count(1)
#: After so many tables the driver's heap, by then mostly plans of ended queries, is collected, so that its process stays small.
TIDY = 8
#: Spark drops the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that one shard holds on average; a shard is what one Python task has in memory.
SHARD_BYTES = 12_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not at and not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="cloakwork-"))
    return (at or _OWN[0]).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended, and the folder with it
        return


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and lost executors cost nothing.

    Shuffle files of the job go as it ends; the table goes with `dropped`, or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_delete, spark, path)
    if next(_WRITTEN) % TIDY == 0:
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._staged_at)


class Sent:
    """An object for all Python workers, as a broadcast of its pickle by value: workers need no copy of its class."""

    def __init__(self, spark: SparkSession, thing: object):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    @property
    def value(self):
        return pickle.loads(self.data.value)


def small_or(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, which is counted here; else df, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def shards_for(df: DataFrame, column: str = "text", each: int = SHARD_BYTES) -> int:
    """How many shards of about `each` bytes the text needs; at least 8, so that small inputs run in parallel too."""
    return max(8, -(-text_bytes(df, column) // each))


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that what a function makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_batches(rows: Iterable, weight: Callable, most: int) -> Iterator[list]:
    """Lists of rows that weigh `most` together; a heavier row comes alone."""
    held, heavy = [], 0
    for row in rows:
        w = weight(row)
        if held and heavy + w > most:
            yield held
            held, heavy = [], 0
        held.append(row)
        heavy += w
    if held:
        yield held


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: each bit of the result depends on all bits of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHash(dict):
    """word (bytes) -> XXH64, remembered; forgotten when too many are held."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
