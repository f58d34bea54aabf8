"""Cost-balanced packing: documents become token ids and fill sequences of at most 2048 tokens.

A piece of n tokens costs LINEAR * n + QUADRATIC * n^2 (attention inside the piece).  Documents are cut into whole
sequences first; what remains of each is taken by descending cost and goes to the sequence of lowest cost that has room,
cut where the room ends.  There are as many such sequences as they fill entirely; the last tokens, fewer than one
sequence, fill sequences whose lengths are powers of two, so no token of padding is needed.

Each task packs what it reads, SHARD_TOKENS at a time: no shuffle, memory bounded by that and the longest document.  A
sequence id has the partition in its upper bits, so a task that runs again after a lost executor gives the same rows.

Defined cases: null text counts as empty and gives the end id alone; a null id stays null; repeated rows are packed each;
ties of cost go by order in the input; extra columns are dropped; an empty table gives no pieces.  Strings of special
tokens in a text become the special ids, as the tokenizer file has them.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SEQUENCE = 2048
END_ID = 1
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
SHARD_TOKENS = 1_500_000
#: The split of byte-level BPE before merges: a fixed value of the public format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_BLANK = 50_000
_BLANKS = re.compile(r"\s{%d}" % LONG_BLANK)
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """text -> list of ids, as the tokenizer file at `path` gives them without added special tokens; a task makes its own.

    Byte-level BPE without a normaliser runs on a faster engine, which gives the same ids, except for texts with runs of
    LONG_BLANK blanks, which it cannot take; these, and all texts under any other file, go through `tokenizers`.
    """
    import tiktoken

    exact = None

    def by_file(text: str) -> list[int]:
        nonlocal exact
        if exact is None:
            from tokenizers import Tokenizer

            exact = Tokenizer.from_file(path)
        return exact.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return by_file
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level BPE
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    enc = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    names = set(special)

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_BLANK and _BLANKS.search(text):
            return by_file(text)
        return enc.encode(text, allowed_special=names) if any(s in text for s in names) else enc.encode_ordinary(text)

    return encode


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def arrange(lengths: list[int], room: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of documents with these many tokens."""
    out, rests, sequence = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // room
        out += [(d, k * room, room, sequence + k, 0) for k in range(whole)]
        sequence += whole
        if n % room:
            rests.append((d, whole * room, n % room))
    rests.sort(key=lambda x: -cost(x[2]))
    left = sum(n for _, _, n in rests)
    bins = [(0.0, sequence + k, 0) for k in range(left // room)]
    sequence += len(bins)
    tail = left % room
    sizes = [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
    small: list[list[int]] = [[sequence + k, 0, size] for k, size in enumerate(sizes)]
    for d, start, n in rests:
        while n:
            if bins:
                spent, s, used = heapq.heappop(bins)
                take = min(n, room - used)
                if used + take < room:
                    heapq.heappush(bins, (spent + cost(take), s, used + take))
            else:
                s, used, size = small[0]
                take = min(n, size - used)
                small[0][1] += take
                if used + take == size:
                    small.pop(0)
            out.append((d, start, take, s, used))
            start, n = start + take, n - take
    return out


def _packer(path: str, end_id: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        first = TaskContext.get().partitionId() << 36

        def packed(held: list[tuple[object, np.ndarray]], base: int) -> tuple[Iterator[pa.RecordBatch], int]:
            pieces = arrange([len(x) for _, x in held], room)
            batches = []
            for at in range(0, len(pieces), 4000):
                some = pieces[at : at + 4000]
                cols = [
                    pa.array([held[d][0] for d, *_ in some], pa.int64()),
                    pa.array([p[1] for p in some], pa.int64()),
                    pa.array([p[2] for p in some], pa.int64()),
                    pa.array([len(held[p[0]][1]) for p in some], pa.int64()),
                    pa.array([base + p[3] for p in some], pa.int64()),
                    pa.array([p[4] for p in some], pa.int64()),
                    pa.array([held[d][1][s : s + n].tobytes() for d, s, n, _, _ in some], pa.binary()),
                ]
                batches.append(pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]))
            return batches, base + 1 + max((p[3] for p in pieces), default=-1)

        held, tokens = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                held.append((doc_id, np.array(ids, dtype="<u4")))
                tokens += len(ids)
                if tokens >= SHARD_TOKENS:
                    done, first = packed(held, first)
                    yield from done
                    held, tokens = [], 0
        if held:
            yield from packed(held, first)[0]

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, room: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, little-endian) of every piece."""
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_packer(path or tokenizer_file(), end_id, room), _SCHEMA)


def pieces(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))
