"""Substring dedup: winnowed anchors seed matches, windows around them extend both ways, maximal repeats go.

A window is WINDOW consecutive words of one document.  A word is removed if some window that covers it also starts anywhere
else, in the same document or another; so what goes are the maximal repeats of at least WINDOW words.

Seed: the anchor of a window is the least hash of the runs of RUN words in it.  Equal windows have equal anchors, and about
one position in 14 is an anchor, so counting anchors is cheap; an anchor that occurs once in all documents ends the search
for its windows.  Extend: each window around a repeated anchor - all extensions to the left and right that are long
enough - is counted by its hash, together with those around the same anchor.  Windows found twice cover the words to be
removed.  Both counts are exchanges of packed arrays between shards of documents and buckets of hashes (exchange.py): a passage
that a third of all documents share has one entry a shard, nothing is paired, and no group meets in one task.

Hashes are 64 bits, windows compete only within the bucket of their own hash.  Documents are read three times, each time dealt to the same shards.

Defined cases: null text has no words, and stays null; repeated rows are documents of their own, so all their windows
repeat; fewer than WINDOW words are never removed; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, in_batches, mixed, shards_for, staged, table
from .exchange import ANSWER, ANSWER_DDL, MESSAGE_DDL, added, deal, messages, narrow, received, run_hashes, unpacked, word_hashes

WINDOW = 35
RUN = 8
BATCH_BYTES = 1_000_000
#: Bytes of text in a shard: two Python workers of an executor each hold one.
SHARD_BYTES = 6_000_000


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each `width` consecutive values."""
    pick, have, out = np.minimum if least else np.maximum, 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


class Words:
    """Anchors and windows of some texts."""

    def __init__(self, texts: list[bytes], window: int, run: int):
        hashes, self.counts = word_hashes(texts)
        n = len(hashes)
        ends = np.repeat(np.cumsum(self.counts), self.counts)
        at = np.arange(n)
        self.starts = np.flatnonzero(ends - at >= window)  # of windows
        self.window, self.n = window, n
        if not len(self.starts):
            self.anchor = self.anchors = self.hash = np.zeros(0, np.uint64)
            return
        grams = run_hashes(hashes, at[: n - run + 1], at[: n - run + 1] + run, 0xD6E8FEB86659FD93) | np.uint64(1)
        width = window - run + 1
        least = sliding(grams, width, True)  # by window start
        self.anchor = least[self.starts]
        by_start = np.zeros(n, dtype=np.uint64)
        by_start[self.starts] = self.anchor
        padded = np.concatenate([np.zeros(width - 1, np.uint64), by_start])
        chosen = sliding(padded, width, False)[: len(grams)] == grams
        self.anchors = grams[chosen]
        self.hash = mixed(run_hashes(hashes, self.starts, self.starts + window) ^ (self.anchor >> np.uint64(7)))

    def cover(self, repeated: np.ndarray) -> np.ndarray:
        """Which words the windows marked in `repeated` cover."""
        change = np.zeros(self.n + 1, dtype=np.int64)
        s = self.starts[repeated]
        np.add.at(change, s, 1)
        np.add.at(change, s + self.window, -1)
        return np.cumsum(change)[:-1] > 0


def _batches(texts: list[bytes], window: int, run: int):
    for some in in_batches(range(len(texts)), lambda i: len(texts[i]), BATCH_BYTES):
        yield some, Words([texts[i] for i in some], window, run)


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
    return keys, np.minimum(counts, 2)


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are in the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values


def _repeats(bucket: pa.Table) -> pa.Table:
    """Answers a bit a key: does it occur twice or more?"""
    keys = [unpacked(x) for x in bucket["keys"].to_pylist()]
    counts = [np.frombuffer(x, np.uint8, offset=1).astype(np.int64) for x in bucket["counts"].to_pylist()]
    _, totals = added(keys, counts)
    return pa.table([bucket["shard"], bucket["bucket"], bucket["kind"], pa.array([narrow((t > 1).astype(np.uint8)) for t in totals], pa.binary())], schema=ANSWER)


def _seeds(window: int, run: int, buckets: int):
    def send(docs: pa.Table) -> pa.Table:
        texts = as_bytes(docs["_text"].combine_chunks())
        keys, counts = _distinct([w.anchors for _, w in _batches(texts, window, run)])
        return messages(docs["_shard"][0].as_py(), 0, keys, counts, buckets)

    return send


def _candidates(texts: list[bytes], answers: pa.Table, window: int, run: int):
    """(batch, words, which windows have a repeated anchor) of all batches."""
    seeds, _ = _distinct([w.anchors for _, w in _batches(texts, window, run)])
    seeds = seeds[received(answers, 0) > 0]
    for some, w in _batches(texts, window, run):
        yield some, w, _among(w.anchor, seeds)


def _extensions(window: int, run: int, buckets: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return messages(0, 1, np.zeros(0, np.uint64), np.zeros(0, np.int64), buckets)
        texts = as_bytes(docs["_text"].combine_chunks())
        keys, counts = _distinct([w.hash[c] for _, w, c in _candidates(texts, answers, window, run)])
        return messages(docs["_shard"][0].as_py(), 1, keys, counts, buckets)

    return send


_OUT = pa.schema([("_id", pa.int64()), ("_rest", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])
_OUT_DDL = "_id long, _rest string, n_words long, n_removed long, kept string, kept_sha256 string"


def _removal(window: int, run: int, keep_text: bool):
    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = as_bytes(docs["_text"].combine_chunks())
        nulls = docs["_text"].is_null().to_pylist() if docs.num_rows else []
        found = list(_candidates(texts, answers, window, run)) if docs.num_rows else []
        keys, _ = _distinct([w.hash[c] for _, w, c in found])
        keys = keys[received(answers, 1) > 0] if len(keys) else keys
        n_words, n_removed, kept, digest = [], [], [], []
        for some, w, c in found:
            gone = w.cover(c & _among(w.hash, keys))
            limits = np.concatenate([[0], np.cumsum(w.counts)])
            for k, i in enumerate(some):
                mask = gone[limits[k] : limits[k + 1]]
                words = texts[i].split()
                if mask.any():
                    words = [x for x, m in zip(words, mask.tolist()) if not m]
                rest = b" ".join(words)
                n_words.append(len(mask))
                n_removed.append(int(mask.sum()))
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append((None if nulls[i] else texts[i].decode() if not mask.any() else rest.decode()) if keep_text else None)
        return pa.table([docs["_id"].cast(pa.int64()), docs["_rest"].cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())], schema=_OUT)

    return remove


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: list[str] | None = None, window: int = WINDOW, run: int = RUN, keep_text: bool = True, shards: int | None = None) -> DataFrame:
    """id, n_words, n_removed, kept, kept_sha256 of every row, with the columns in `rest`.

    kept: the text as it was if nothing is removed, else the words that stay, one space apart; kept_sha256 is of the
    words that stay, one space apart, always.
    """
    df = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), (F.to_json(F.struct(*rest)) if rest else F.lit(None).cast("string")).alias("_rest"))
    n = shards or shards_for(df, "_text", SHARD_BYTES)
    # the shard of a row is a hash of its id and text: the same in each of the three readings
    dealt = deal(df, n, ("_id", "_id"), ("_text", "_text"), ("_rest", "_rest"))
    by_shard = dealt.groupBy("_shard")
    sent = by_shard.applyInArrow(_seeds(window, run, n), MESSAGE_DDL)
    first = staged(sent.groupBy("bucket").applyInArrow(_repeats, ANSWER_DDL), "seeds")
    sent = by_shard.cogroup(first.groupBy("shard")).applyInArrow(_extensions(window, run, n), MESSAGE_DDL)
    second = staged(sent.groupBy("bucket").applyInArrow(_repeats, ANSWER_DDL), "windows")
    found = by_shard.cogroup(first.union(second).groupBy("shard")).applyInArrow(_removal(window, run, keep_text), _OUT_DDL)
    if not rest:
        return found.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept", "kept_sha256")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return found.withColumn("_rest", F.from_json("_rest", kinds)).select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept", "kept_sha256", *[F.col(f"_rest.`{c}`").alias(c) for c in rest])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without repeated passages; a document of which no word is left goes."""
    found = dedup_substrings(docs, rest=["lang", "source", "n_chars"])
    left = found.where("n_removed = 0 or n_removed < n_words")
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i) WHERE len(w) >= 35),
twice AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, j FROM g JOIN twice USING (g), LATERAL (SELECT unnest(range(i, i + 35)) AS j)),
lists AS (SELECT r, list(j) AS js FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (r)
"""
