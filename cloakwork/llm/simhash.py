"""SimHash near-duplicates by a segment-popcount embedding and a grid.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the shingles' XXH64.  The embedding maps a fingerprint
to the bit counts of its segments.  The Manhattan distance of embeddings never exceeds the Hamming distance of
fingerprints, so fingerprints at most MAX_BITS apart have equal counts in all but MAX_BITS groups of segments: each choice of
the other groups is a grid cell, and two linked fingerprints share a cell.  In a cell the Manhattan distance is the first
test and the Hamming distance the last.

Copies are one fingerprint before any join.  A cell with more than CELL fingerprints passes them on, whole, to the next of three grids
with finer segments and more choices; cells of the last hold at most 2^12 fingerprints that differ in 12 given bits, so
work grows with the number of fingerprints whatever their groups.  Cells give each member's link to the least one it
reaches there, not all pairs.

Defined cases: null or empty text has fingerprint zero, which links like any other; repeated rows stay; a null id is never
a component's id unless all its members' ids are null; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, as_bytes, dropped, mixed, small, small_or, staged, table
from .exchange import run_hashes, word_hashes
from .graph import components

SHINGLE = 3
MAX_BITS = 3
CELL = 256
#: (bits of a segment, groups of segments); cells take all but MAX_BITS of the groups.
GRIDS = [(2, 6), (1, 8), (1, 16)]
#: How many hashes a sketch holds.
SKETCH = 256
#: Frequent shingles that a task reports from so many, and that are held; they only order prefixes, which is right in any order.
REPORTED, COUNTED, HEAVY = 2000, 2_000_000, 50_000
#: Members of a cell all of whose pairs are compared at once; in larger ones, members with which all are compared first.
WHOLE, HUBS = 8, 2
#: Members of a cell that a task takes twice, at most; shingles of a text whose hashes travel in full; bins of one with more.
PART, FULL, BINS = 20_000, 256, 512
#: Standard errors from the bound at which a signature settles a pair, and the least size of sets that it settles.
FAR, SHORT = 5, 8
#: So many ids are broadcast at most (8 MB of them), so that texts need not move; more are joined by a shuffle.
FEW = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EVEN = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of the UTF-8 text; words are what blanks and \\x09 to \\x0d part."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    ends = ends.tolist()
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    bits, n = np.zeros(64, dtype=np.int64), len(words) - k + 1
    for at in range(0, n, 50_000):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : min(n, at + 50_000)], ends[at + k - 1 :])], dtype="<u8")
        bits += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = np.array([fingerprint(x, shingle) for x in as_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["_id", "_fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, _fp) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_fingerprints(shingle), "_id long, _fp long")


def grid_masks(bits: int, groups: int, apart: int) -> list[int]:
    """A mask of the embedding for each choice of all but `apart` groups of segments."""
    lanes = [((1 << bits) - 1) << k for k in range(0, 64, bits)]
    parts = [sum(x.tolist()) for x in np.array_split(np.array(lanes, dtype=object), groups)]
    masks = [sum(c) for c in itertools.combinations(parts, groups - apart)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def cells(fps: DataFrame, bits: int, groups: int, apart: int) -> DataFrame:
    """(cell, _fp): each fingerprint in all its grid cells."""
    fp = F.col("_fp")
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    embedded = fp if bits == 1 else F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))
    masks = F.array(*[F.lit(m).cast("long") for m in grid_masks(bits, groups, apart)])
    wide = fps.select("_fp", embedded.alias("_e")).select("_fp", "_e", F.explode(masks).alias("_m"))
    return wide.select(F.xxhash64("_m", F.col("_e").bitwiseAND(F.col("_m"))).alias("cell"), "_fp")


def stars(cell: np.ndarray, fp: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what is at most `apart` bits away within a cell; rows of a cell stand together."""
    counts = np.bitwise_count(fp.view(np.uint8)).reshape(-1, 8).astype(np.int8)
    left, right = [], []
    at = np.arange(len(cell))
    for d in range(1, len(cell)):
        at = at[: np.searchsorted(at, len(cell) - d)]
        at = at[cell[at] == cell[at + d]]
        if not len(at):
            break
        near = at[np.abs(counts[at] - counts[at + d]).sum(1) <= apart]
        near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= apart]
        left.append(near)
        right.append(near + d)
    if not left:
        return fp[:0], fp[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(cell))
    while True:
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(old, label):
            break
    out = np.flatnonzero(label != np.arange(len(cell)))
    return fp[out], fp[label[out]]


def _links(apart: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = stars(c, f.view(np.uint64), apart)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        c = f = np.zeros(0, dtype=np.int64)
        for batch in batches:
            c = np.concatenate([c, batch.column(0).to_numpy()])
            f = np.concatenate([f, batch.column(1).to_numpy()])
            if len(c):
                cut = int(np.searchsorted(c, c[-1], "left"))
                yield of(c[:cut], f[:cut])
                c, f = c[cut:], f[cut:]
        yield of(c, f)

    return run


def links(fps: DataFrame, apart: int = MAX_BITS, grids: list[tuple[int, int]] = GRIDS, most: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (_fp) that connect all that are at most `apart` bits away."""
    found = None
    for level, (bits, groups) in enumerate(grids):
        wide = cells(fps, bits, groups, apart)
        hot = None
        if level + 1 < len(grids):
            hot = staged(wide.groupBy("cell").count().where(F.col("count") > most).select("cell"), "hot")
            hot_cells = small_or(hot, 500_000)
            cold = wide.join(hot_cells, "cell", "left_anti")
        else:
            cold = wide
        got = staged(cold.repartition("cell").sortWithinPartitions("cell", "_fp").mapInArrow(_links(apart), "a long, b long"), "links")
        found = got if found is None else found.union(got)
        if hot is None or hot.isEmpty():
            break
        fps = staged(wide.join(hot_cells, "cell", "left_semi").select("_fp").distinct(), "refined")
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, apart: int = MAX_BITS) -> DataFrame:
    """id, _fp (the fingerprint as a signed long), component_id (the least id reachable by links) of every row."""
    fps = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = staged(fps.groupBy("_fp").agg(F.min("_id").alias("_first")), "distinct")
    roots = components(links(first.select("_fp"), apart))
    member = first.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    least = member.groupBy("root").agg(F.min("_first").alias("component_id"))
    by_fp = staged(member.join(least, "root").select("_fp", "component_id"), "members")
    return fps.join(by_fp, "_fp").select(F.col("_id").alias(id_col), "_fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the text's distinct runs of `words` words; a shorter text is one run, one without words has none."""
    hashes, _ = word_hashes([text.translate(_LOWER)])
    k = min(words, len(hashes))
    at = np.arange(len(hashes) - k + 1 if k else 0)
    return np.unique(run_hashes(hashes, at, at + k)) if k else np.zeros(0, np.uint64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.md5(x).digest() for x in as_bytes(batch.column(1))], pa.binary())], names=["_id", "_t"])


def _frequent(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(h, n) of the shingles that most texts of a task share."""

        def most(held: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            top = np.argsort(-n, kind="stable")[:REPORTED]
            top = top[n[top] > 1]
            return pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(n[top].astype(np.int64))], names=["h", "n"])

        held, size = [], 0
        for batch in small(batches):
            for text in as_bytes(batch.column(1)):
                held.append(shingles(text, words))
                size += len(held[-1])
            if size > COUNTED:
                yield most(held)
                held, size = [], 0
        yield most(held)

    return run


def signature(h: np.ndarray) -> tuple[int, int]:
    """SimHash of a set of shingle hashes, in two words of 64 bits (signed)."""
    out = []
    for x in (h, mixed(h)):
        bits, n = np.zeros(64, dtype=np.int64), len(x)
        for at in range(0, n, 50_000):
            bits += np.unpackbits(x[at : at + 50_000].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out.append(int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0]))
    return out[0], out[1]


def may_be_near(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows (size, signature, signature) of x and y may be as similar as `least`.

    Bits of signatures differ with the angle between the sets over pi; FAR standard errors beyond that at `least` are
    out.  The smallest sets always may be.
    """
    p = math.acos(2 * least / (1 + least)) / math.pi
    apart = np.bitwise_count((x[:, 1:] ^ y[:, 1:]).view(np.uint64)).sum(1, dtype=np.int64)
    sizes = np.minimum(x[:, 0], y[:, 0])
    return (sizes >= least * np.maximum(x[:, 0], y[:, 0]) - 1e-9) & ((apart <= 128 * p + FAR * math.sqrt(128 * p * (1 - p))) | (sizes < SHORT))


_PREFIX_DDL = "token long, at long, _id long, s1 long, s2 long"


def _prefixes(heavy: Sent, words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(token, at, _id, signature): the rarest shingles of each text, so many that texts as similar as `least` share one of them; at: size and place."""
        known, often = heavy.value
        for batch in small(batches):
            tokens, sizes, signed = [], [], []
            for text in as_bytes(batch.column(1)):
                h = shingles(text, words)
                h = h if len(h) else np.zeros(1, np.uint64)  # texts without words meet here
                signed.append(signature(h))
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.lexsort((h, np.where(known[at] == h, often[at], 0)))]
                tokens.append(h[: len(h) - math.ceil(least * len(h) - 1e-9) + 1])
                sizes.append(len(h))
            if tokens:
                each = [len(t) for t in tokens]
                place = np.concatenate([np.arange(k) for k in each])
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                both = np.array(signed, dtype=np.int64).reshape(-1, 2)
                columns = [np.concatenate(tokens).view(np.int64), (np.repeat(np.array(sizes, np.int64), each) << 32) + place, *(np.repeat(x, each) for x in (ids, both[:, 0], both[:, 1]))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "at", "_id", "s1", "s2"])

    return run


_CELL = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("members", pa.binary())])


def _pairs_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each pair once, the greater id first."""
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.binary())], schema=_CELL)


def _cells(least: float, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of small cells that may be similar enough, and larger cells, packed; rows come in order of token, size and id."""

        def of(token: np.ndarray, at: np.ndarray, ids: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([starts, [len(token)]]))
            row = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= whole), sizes))
            n, place = at >> 32, at & 0xFFFFFFFF
            members = np.stack([n, s1, s2], 1)
            left, right = [ids[:0]], [ids[:0]]
            for d in range(1, whole):
                row = row[row + d < len(token)]
                row = row[token[row] == token[row + d]]
                need = np.ceil(least / (1 + least) * (n[row] + n[row + d]) - 1e-9)  # shingles in common
                may = row[np.minimum(n[row] - place[row], n[row + d] - place[row + d]) + np.minimum(place[row], place[row + d]) >= need]
                may = may[may_be_near(members[may], members[may + d], least)]
                left.append(ids[may])
                right.append(ids[may + d])
            yield _pairs_of(np.concatenate(left), np.concatenate(right))
            large = np.flatnonzero(sizes > whole)
            packs = [np.column_stack([ids[x:y], members[x:y]]).astype("<i8").tobytes() for x, y in ((starts[k], starts[k] + sizes[k]) for k in large)]
            none = pa.nulls(len(packs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(packs, pa.binary())], schema=_CELL)

        held = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            held = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(held)]
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1], "left"))
                yield from of(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        yield from of(*held)

    return run


def _with_hubs(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the HUBS least ids of a packed cell with all others: cells of one group mostly have the same ones."""
        for batch in batches:
            for pack in batch.column(0).to_pylist():
                cell = np.frombuffer(pack, "<i8").reshape(-1, 4)
                cell = cell[np.argsort(cell[:, 0], kind="stable")]
                left, right = [], []
                for k in range(HUBS):
                    may = k + 1 + np.flatnonzero(may_be_near(np.broadcast_to(cell[k, 1:], (len(cell) - k - 1, 3)), cell[k + 1 :, 1:], least))
                    left.append(cell[may, 0])
                    right.append(np.full(len(may), cell[k, 0]))
                yield _pairs_of(np.concatenate(left), np.concatenate(right)).select(["a", "b"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, parts, _id) of every member of packed cells; a cell has so many parts that two of them fit into a task."""
    import xxhash

    for batch in batches:
        for pack in batch.column(0).to_pylist():
            ids = np.frombuffer(pack, "<i8").reshape(-1, 4)[:, 0]
            cell, parts = np.uint64(xxhash.xxh64_intdigest(pack)).view(np.int64), -(-len(ids) // PART)
            for at in range(0, len(ids), 100_000):
                some = ids[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), cell)), pa.array(np.full(len(some), parts, np.int32)), pa.array(some)], names=["cell", "parts", "_id"])


def bins(h: np.ndarray) -> np.ndarray:
    """The least hash of each of BINS ranges, in 16 bits; 0 where there is none.  h: sorted, the upper 32 bits of hashes."""
    out = np.zeros(BINS, dtype="<u2")
    at, first = np.unique(h // np.uint32((1 << 32) // BINS), return_index=True)
    out[at.astype(np.int64)] = np.maximum(1, h[first] & np.uint32(0xFFFF))
    return out


def _binned(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(_id, n, hashes): the upper halves of all hashes of a set of up to FULL, the bins of a larger one."""
        for batch in small(batches):
            found = [(shingles(text, words) >> np.uint64(32)).astype("<u4") for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in found], pa.int32()), pa.array([(h if len(h) <= FULL else bins(h)).tobytes() for h in found], pa.binary())], names=["_id", "n", "hashes"])

    return run


def _across(least: float):
    def run(cell: pa.Table) -> pa.Table:
        """Pairs of members of different groups that their hashes don't settle to be apart: sets in full are compared exactly, others by bins."""
        ids, group, n = (cell[c].to_numpy() for c in ("_id", "root", "n"))
        raw = cell["hashes"].to_pylist()
        held = np.zeros((len(ids), BINS), dtype="<u2")
        full = np.zeros((len(ids), min(FULL, int(n.max(initial=1)))), dtype="<u4")
        for k, x in enumerate(raw):
            if n[k] <= FULL:
                full[k, : n[k]] = h = np.frombuffer(x, "<u4")
                held[k] = bins(h)
            else:
                held[k] = np.frombuffer(x, "<u2")
        names, which, count = np.unique(group, return_inverse=True, return_counts=True)
        largest = which == int(np.argmax(count))
        left, right = [ids[:0]], [ids[:0]]
        every = np.arange(len(ids))
        for k in np.flatnonzero(~largest) if len(names) > 1 else ():
            other = every[(largest | (every > k)) & (which != which[k])]
            other = other[np.minimum(n[other], n[k]) >= least * np.maximum(n[other], n[k]) - 1e-9]
            both = other[n[other] <= FULL] if n[k] <= FULL else other[:0]
            if len(both):
                mine, theirs = full[k, : n[k]], full[both]
                at = np.minimum(np.searchsorted(mine, theirs), n[k] - 1)
                alike = ((mine[at] == theirs) & (np.arange(theirs.shape[1]) < n[both][:, None])).sum(1)
                both = both[alike >= least / (1 + least) * (n[both] + n[k]) - 1e-9]
            rest = other[n[other] > FULL] if n[k] <= FULL else other
            used = np.count_nonzero(held[rest] | held[k], axis=1)
            alike = np.count_nonzero((held[rest] == held[k]) & (held[k] > 0), axis=1)
            # a bin draws one of the hashes of both texts, none of them twice: four standard errors, and one bin for the small
            drawn = np.minimum(1, used * (1 + least) / (n[rest] + n[k]))
            rest = rest[alike >= least * used - 4 * np.sqrt(least * (1 - least) * used * (1 - drawn)) - 1]
            near = np.concatenate([both, rest])
            left.append(np.full(len(near), ids[k]))
            right.append(ids[near])
        return pa.Table.from_batches([_pairs_of(np.concatenate(left), np.concatenate(right)).select(["a", "b"])])

    return run


def across(df: DataFrame, large: DataFrame, found: DataFrame, words: int, least: float) -> DataFrame:
    """Pairs (a, b) of members of packed cells that the links found so far don't connect and that may be similar enough.

    Cells of over PART members are taken two parts at a time, so no task holds more than two.
    """
    members = staged(large.mapInArrow(_members, "cell long, parts int, _id long"), "members")
    ids = members.select("_id").distinct()
    held = staged(df.join(small_or(staged(ids, "ids"), FEW), "_id", "left_semi").mapInArrow(_binned(words), "_id long, n int, hashes binary").dropDuplicates(["_id"]), "hashes")
    roots = components(found).select(F.col("node").alias("_id"), "root").distinct()
    rows = members.join(held.join(roots, "_id", "left").withColumn("root", F.coalesce("root", "_id")), "_id")
    mine = F.pmod(F.xxhash64("_id"), F.col("parts"))
    rows = rows.withColumn("_mine", mine).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - F.lit(1).cast("long"))))
    rows = rows.select("cell", F.least("_mine", "_with").alias("_low"), F.greatest("_mine", "_with").alias("_high"), "_id", "root", "n", "hashes")
    return rows.groupBy("cell", "_low", "_high").applyInArrow(_across(least), "a long, b long").distinct()


def _sketches(words: int, size: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least `size` hashes of each text's shingles, sorted; all of them if there are fewer, or without a size."""
        for batch in small(batches):
            out = []
            for text in as_bytes(batch.column(1)):
                out.append(shingles(text, words)[:size].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["_id", "_sketch"])

    return run


def similarity(a: bytes, b: bytes, size: int | None) -> tuple[float, bool]:
    """(Jaccard similarity of two sketches, whether it is exact); an estimate comes from the least `size` hashes of both."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    exact = size is None or max(len(x), len(y)) < size
    every = np.union1d(x, y)
    every = every if exact else every[:size]
    return float(np.isin(every, np.intersect1d(x, y)).mean()) if len(every) else 1.0, exact


def _compared(size: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [similarity(x, y, size) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in found], pa.float64()), pa.array([e for _, e in found], pa.bool_())], names=["a", "b", "similarity", "exact"])

    return run


def compared(df: DataFrame, pairs: DataFrame, words: int, size: int | None) -> DataFrame:
    """pairs (a, b) of ids in df (_id, _text) with the similarity of their shingles, and whether it is exact."""
    ends = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    ends = staged(ends, "ends")
    sketch = staged(df.join(small_or(ends, FEW), "_id", "left_semi").mapInArrow(_sketches(words, size), "_id long, _sketch binary").dropDuplicates(["_id"]), "sketches")
    a, b = (sketch.select(F.col("_id").alias(c), F.col("_sketch").alias(f"_s{c}")) for c in "ab")
    out = staged(pairs.join(a, "a").join(b, "b").select("a", "b", "_sa", "_sb").mapInArrow(_compared(size), "a long, b long, similarity double, exact boolean"), "compared")
    dropped(ends, sketch)
    return out


def _verified(df: DataFrame, pairs: DataFrame, words: int, least: float, size: int) -> DataFrame:
    """The pairs that are as similar as `least`: sketches settle those far from the bound, all shingles the others."""
    margin = 4 * (0.25 / size) ** 0.5  # four standard errors of an estimate, at the most
    rough = compared(df, pairs, words, size)
    close = rough.where(~F.col("exact") & (F.abs(F.col("similarity") - least) < margin)).select("a", "b")
    sure = rough.where(F.col("exact") | (F.abs(F.col("similarity") - least) >= margin))
    return sure.union(compared(df, close, words, None)).where(F.col("similarity") >= least).select("a", "b")


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, size: int = SKETCH, id_col: str = "doc_id", text_col: str = "text", whole: int = WHOLE) -> DataFrame:
    """Links (a, b) of ids that connect all texts whose shingles of `words` words have a similarity of `least` or more.

    Prefix filtering proposes pairs, and misses none: of texts with n shingles, n - ceil(least n) + 1 of each are taken in one
    order of all shingles, rare ones first, so texts that are similar enough share one of these, which is their cell.  Cells
    of up to `whole` texts give all pairs.  In larger ones all are first compared with the HUBS least ids; then members
    that verified links do not connect are compared in the cell, short ones exactly and others by binned minima of their hashes, and what these do not
    settle is verified.  So groups of near copies give few pairs each, and only texts that links connect anyway are not compared.
    Signatures - SimHash again, of 128 bits - travel with the shingles and settle which pairs of a cell are far from the bound.
    Copies are one text here; ids must tell texts apart.
    """
    df = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null")
    spark = df.sparkSession
    first = staged(df.mapInArrow(_digests, "_id long, _t binary").groupBy("_t").agg(F.min("_id").alias("_id")).select("_id"), "first")
    texts = df.join(small_or(first, FEW), "_id", "left_semi")
    heavy = texts.mapInArrow(_frequent(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HEAVY).collect()
    h, n = (np.array([r[k] for r in heavy], dtype=np.int64) for k in (0, 1))
    order = np.argsort(h.view(np.uint64))
    rows = texts.mapInArrow(_prefixes(Sent(spark, (h.view(np.uint64)[order], n[order])), words, least), _PREFIX_DDL)
    met = staged(rows.repartition("token").sortWithinPartitions("token", "at", "_id").mapInArrow(_cells(least, whole), "a long, b long, members binary"), "cells")
    pairs = met.where("a is not null").select("a", "b")
    large = staged(met.where("members is not null").select("members").distinct(), "large")
    pairs = staged(pairs.union(large.mapInArrow(_with_hubs(least), "a long, b long")).distinct(), "pairs")
    found = staged(_verified(df, pairs, words, least, size), "verified")
    dropped(met, first, pairs)
    if large.isEmpty():
        return found
    pairs = staged(across(df, large, found, words, least), "across")
    return found.union(staged(_verified(df, pairs, words, least, size), "verified"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, apart: int = MAX_BITS, words: int = 5, least: float = 0.8) -> DataFrame:
    """docs with the document of the least id of each group; of repeated rows of that id one stays.  Rows without an id all stay.

    A group is what two kinds of links connect: fingerprints of `shingle` words at most `apart` bits apart, all of
    them, and texts whose shingles of `words` words have a similarity of `least` or more (near_copies).
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    found = staged(near_duplicates(docs, shingle=shingle, apart=apart), "components")
    both = near_copies(docs, words, least).union(found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    roots = components(both.distinct()).select(F.col("node").alias("doc_id"), "root")
    stay = found.join(roots, "doc_id", "left").where("doc_id is null or doc_id = coalesce(root, component_id)")
    stay = staged(stay.groupBy("doc_id").count(), "stay")
    kept = docs.join(small_or(stay.select(F.col("doc_id").alias("_stay")), FEW), F.col("doc_id").eqNullSafe(F.col("_stay")), "left_semi")
    if not stay.where("doc_id is not null and count > 1").isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("_fp")).alias("fingerprint"), "component_id")
