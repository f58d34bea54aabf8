"""Counting keys of all documents: shards of documents and buckets of keys exchange packed arrays.

Documents are dealt to shards by a hash.  A shard sends each bucket the distinct keys it has there, sorted, with their
counts; a bucket adds up what all shards sent and answers each shard with an array aligned to the keys it sent.  A key has
one entry a shard however often it occurs there, so a word, line or passage of a third of all documents weighs no more
than any other; buckets and shards are of like size at every scale, and answers cost a bit or a few per key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed

MESSAGE = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()), ("counts", pa.binary())])
MESSAGE_DDL = "bucket int, shard int, kind byte, keys binary, counts binary"
ANSWER = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int8()), ("values", pa.binary())])
ANSWER_DDL = "shard int, bucket int, kind byte, values binary"
#: Bytes of text whose keys one bucket holds on average: as a bucket is what one Python task has in memory.
BUCKET_BYTES = 24_000_000
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, base: int = _BASE, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or of its inverse."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), pow(base, -1, 1 << 64) if inverse else base, dtype=np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if n <= 1 << 22:
            _POWERS[base, inverse] = have
    return have[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, from sums of prefixes."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values), base), out=sums[1:])
    out = sums[ends] - sums[starts]
    out *= powers(len(values) + 1, base, True)[starts]
    out += (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, number of words of each text); words are what blanks and \\x09 to \\x0d part."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before = np.concatenate([[True], blank[:-1]])
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
    return run_hashes(_BYTE[raw], starts, ends) if len(starts) else np.zeros(0, np.uint64), counts


def deal(docs: DataFrame, shards: int, *columns: tuple[str, str]) -> DataFrame:
    """(_shard, columns...) of every row; the shard depends on all of the columns."""
    df = docs.select(*[F.col(c).alias(name) for c, name in columns])
    return df.select(F.pmod(F.xxhash64(*[name for _, name in columns]), F.lit(shards)).cast("int").alias("_shard"), "*")


def narrow(values: np.ndarray) -> bytes:
    """The array in the smallest unsigned type, with a byte that names it."""
    most = int(values.max(initial=0))
    kind = next(k for k, size in enumerate((8, 16, 32, 64)) if most < 1 << size)
    return bytes([kind]) + values.astype(("u1", "<u2", "<u4", "<u8")[kind]).tobytes()


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ("u1", "<u2", "<u4", "<u8")[data[0]], offset=1).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the low bytes of their differences, as many as most need; the few wider ones follow, whole."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = 8
    while width > 1 and np.count_nonzero(gaps >> np.uint64(8 * (width - 1))) * 12 < len(gaps):
        width -= 1
    wide = np.flatnonzero(gaps >> np.uint64(8 * width)) if width < 8 else np.zeros(0, np.int64)
    head = np.array([width, len(keys), len(wide)], "<u4").tobytes()
    return head + wide.astype("<u4").tobytes() + gaps[wide].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width, n, m = np.frombuffer(data, "<u4", 3).tolist()
    at = np.frombuffer(data, "<u4", m, 12)
    low = np.zeros((n, 8), dtype=np.uint8)
    low[:, :width] = np.frombuffer(data, np.uint8, n * width, 12 + 12 * m).reshape(n, width)
    gaps = low.view("<u8").ravel()
    gaps[at] = np.frombuffer(data, "<u8", m, 12 + 4 * m)
    return np.cumsum(gaps, dtype=np.uint64)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that have keys, limits of each in the sorted keys): buckets are ranges of the upper 32 bits."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    full, first = np.unique(of, return_index=True)
    return full, np.concatenate([first, [len(keys)]])


def messages(shard: int, kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """What a shard sends: keys are sorted, each once."""
    full, limits = by_bucket(keys, buckets)
    parts = list(zip(limits[:-1].tolist(), limits[1:].tolist()))
    return pa.table([pa.array(full, pa.int32()), pa.array([shard] * len(full), pa.int32()), pa.array([kind] * len(full), pa.int8()), pa.array([packed(keys[a:b]) for a, b in parts], pa.binary()), pa.array([narrow(counts[a:b]) for a, b in parts], pa.binary())], schema=MESSAGE)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(total of each distinct key, totals aligned to each list of keys)."""
    every = np.concatenate(keys)
    _, at = np.unique(every, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
    return total, np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])


def received(answers: pa.Table, kind: int) -> np.ndarray:
    """The values a shard gets, aligned to the sorted keys that it sent."""
    rows = [(b, v) for b, k, v in zip(answers["bucket"].to_pylist(), answers["kind"].to_pylist(), answers["values"].to_pylist()) if k == kind]
    return np.concatenate([widen(v) for _, v in sorted(rows)]) if rows else np.zeros(0, np.int64)
