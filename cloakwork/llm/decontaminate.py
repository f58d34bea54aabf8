"""Benchmark decontamination: a broadcast set of normalised test n-grams against every window of the training words.

Words: A-Z lower-cased, then runs of 0-9, a-z and all non-ASCII characters.  A window is `n` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window.  Benchmark words get numbers; a document's words are
looked up once, rolling hashes of the numbers are searched in the sorted hashes of the windows, and each hit is verified
number by number, so that equal hashes of different windows do no harm.

The windows are broadcast up to MAX_BENCHMARK_BYTES of benchmark text, which is measured first (a window takes about 60 bytes, a
byte of text about 12, so a worker holds some 50 MB); a larger benchmark is taken in parts of that size, one pass over the documents for each, and no part is left out.

Defined cases: null text has no words; repeated documents and items stay repeated; an item without words matches
nothing; ids of items may be of any type, an item with a null id counts as one item that has no name; extra columns are dropped; an empty table gives an empty result (documents) or no hits (benchmark).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, as_bytes, in_batches, small, staged, table, text_bytes

WINDOW = 10
MAX_BENCHMARK_BYTES = 4_000_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """The windows of some items, ready to be searched: distinct ones in order of their hashes, with the items that have each."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.number: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        found: dict[int, tuple[list, list]] = {}
        for at, (_, text) in enumerate(items):
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in fold_words(text)], dtype=np.int32)
            if len(ids):
                size = min(n, len(ids))
                words, owners = found.setdefault(size, ([], []))
                words.append(np.lib.stride_tricks.sliding_window_view(ids, size))
                owners.append(np.full(len(words[-1]), at, dtype=np.int32))
        self.by_size = {}
        for size, (words, owners) in found.items():
            every, at = np.unique(np.concatenate(words), axis=0, return_inverse=True)
            h = self.rolled(every.ravel(), size)[::size]
            order = np.argsort(h, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            at = place[at.ravel()]
            by_window = np.argsort(at, kind="stable")
            limits = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(every)))])
            self.by_size[size] = (h[order], every[order], np.concatenate(owners)[by_window], limits)

    @staticmethod
    def rolled(ids: np.ndarray, size: int) -> np.ndarray:
        """The hash of each run of `size` numbers."""
        out = np.zeros(max(0, len(ids) - size + 1), dtype=np.uint64)
        x = ids.astype(np.uint64)
        for j in range(size):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += x[j : j + len(out)]
        return out

    def hits(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(start, size, items) of each window that occurs; ids: of words of many documents, ends: where the word's document ends."""
        out = []
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, (sorted_h, words, owners, limits) in self.by_size.items():
            n = len(ids) - size + 1
            if n <= 0:
                continue
            starts = np.flatnonzero((known[size:] - known[:n] == size) & (ends[:n] - np.arange(n) >= size))
            h = np.zeros(len(starts), dtype=np.uint64)
            for j in range(size):
                h = h * np.uint64(0x9E3779B97F4A7C15) + ids[starts + j].astype(np.uint64)
            lo, hi = np.searchsorted(sorted_h, h, "left"), np.searchsorted(sorted_h, h, "right")
            for k in np.flatnonzero(hi > lo):
                s = int(starts[k])
                out += [(s, size, owners[limits[w] : limits[w + 1]].tolist()) for w in range(lo[k], hi[k]) if np.array_equal(words[w], ids[s : s + size])]
        return out


_ARROW = pa.schema([("_id", pa.int64()), ("_text", pa.string()), ("n_words", pa.int64()), ("_starts", pa.list_(pa.int64())), ("_ends", pa.list_(pa.int64())), ("_items", pa.list_(pa.string()))])


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _scan(windows, keep_text: bool):
    """A function for mapInArrow: adds word spans and items of hits to those that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        get = known.number.get
        for batch in small(batches):
            texts = as_bytes(batch.column(1))
            n_words = [0] * len(texts)
            spans = [list(zip(a or [], b or [])) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            items = [set(x or []) for x in batch.column(5).to_pylist()]
            for some in in_batches(range(len(texts)), lambda i: len(texts[i]), 4_000_000):
                ids, begins = [], []
                for i in some:
                    words = fold_words(texts[i])
                    n_words[i] = len(words)
                    begins.append(len(ids))
                    ids += [get(w, 0) for w in words]
                begins.append(len(ids))
                begins = np.array(begins)
                ends = np.repeat(begins[1:], np.diff(begins))
                for start, size, owners in known.hits(np.array(ids, dtype=np.int64), ends):
                    k = int(np.searchsorted(begins, start, "right")) - 1
                    at = start - int(begins[k])
                    spans[some[k]].append((at, at + size))
                    items[some[k]].update(known.ids[o] for o in owners)
            spans = [_joined(x) for x in spans]
            text = batch.column(1) if keep_text else pa.nulls(len(texts), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string()), pa.array(n_words, pa.int64()), pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int64())), pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int64())), pa.array([sorted(x, key=lambda i: (i is None, i or "")) for x in items], pa.list_(pa.string())), *(batch.column(c) for c in range(6, batch.num_columns))], schema=pa.schema([*_ARROW, *(batch.schema.field(c) for c in range(6, batch.num_columns))]))

    return run


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, item_col: str, keep_text: bool, max_bytes: int, carried: tuple[str, ...] = (), finish: tuple | None = None) -> DataFrame:
    """What _scan gives after all parts of the benchmark; finish: a function of its last batches, in the same worker, and the schema of what that gives."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("_item"), F.col("text").alias("_text")).where("_text is not null")
    parts = max(1, -(-text_bytes(bench, "_text") // max_bytes))
    none = F.array().cast("array<long>")
    df = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.lit(0).cast("long").alias("n_words"), none.alias("_starts"), none.alias("_ends"), none.cast("array<string>").alias("_items"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carried)])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    for k in range(parts):
        some = bench.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(parts)) == k).collect()  # at most about max_bytes
        windows = Sent(spark, Windows([(r[0], r[1].encode()) for r in some], n))
        last = k == parts - 1
        scan = _scan(windows, keep_text or not last)
        if last and finish:
            return df.mapInArrow(lambda batches: finish[0](scan(batches)), finish[1])
        df = df.mapInArrow(scan, schema)
        if not last:
            df = staged(df, "hits")
    return df


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep_text: bool = True, max_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """doc id, text, n_words, word spans [start, end) of hits (arrays starts, ends) and items with hits, for every document."""
    df = _scanned(docs, benchmark, n, id_col, text_col, item_col, keep_text, max_bytes)
    return df.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "n_words", F.col("_starts").alias("starts"), F.col("_ends").alias("ends"), F.col("_items").alias("items"))


def cut_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """text without the characters from the first to the last word of each span."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in zip(starts, ends):
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def _cut(remove: str):
    """What makes clean documents of the batches of _scan: texts without the spans found in them, all spans at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, starts, ends = (batch.column(k).to_pylist() for k in (2, 3, 4))
            new, stay = {}, np.ones(batch.num_rows, dtype=bool)
            for i, (a, b) in enumerate(zip(starts, ends)):
                if a and (remove == "documents" or sum(b) - sum(a) == n_words[i]):
                    stay[i] = False
                elif a:
                    new[i] = cut_spans(batch.column(1)[i].as_py(), a, b)
            text, chars = batch.column(1), batch.column(8)
            if new:
                text, chars = text.to_pylist(), chars.to_pylist()
                for i, x in new.items():
                    text[i], chars[i] = x, len(x)
                text, chars = pa.array(text, pa.string()), pa.array(chars, batch.schema.field(8).type)
            out = pa.RecordBatch.from_arrays([batch.column(0), text, batch.column(6), batch.column(7), chars], names=["doc_id", "text", "lang", "source", "n_chars"])
            yield out if stay.all() else out.filter(pa.array(stay))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = WINDOW, max_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without what the benchmark holds.

    remove="documents" drops documents with a hit.  remove="spans" cuts the words that are hit, and drops a document only
    if no word is left of it; documents without a hit stay as they are.  Spans of all parts of a large benchmark are found
    in the unchanged text, then cut at once.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    return _scanned(kept, benchmark, n, "doc_id", "text", "item_id", True, max_bytes, ("lang", "source", "n_chars"), (_cut(remove), kept.schema))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    names = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
h AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM h, LATERAL (SELECT unnest(range(i, i + k)) AS j) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""
