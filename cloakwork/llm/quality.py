"""Quality classifier by co-training of a text view and a metadata view.

The text view has features of the content: word stems (prefixes of four to six letters, present or not) that tell labelled
documents apart.  The metadata view has what is known about the document apart from its words: source, lang, length, and
counts that a crawler keeps of a page - shares of odd words, repeats, capitals, digits and the like.  Each view is a
logistic regression.  In each of ROUNDS rounds each view takes the unlabelled documents that it is most confident about, at
most EXCHANGED in proportion to the classes, with CONFIDENT or more on its calibrated scale, and hands their labels to the other
view, which learns from them besides the labels.  Views are calibrated on labelled documents that neither learned from; the
two calibrated views combined - as evidence that is independent given the class, which is what co-training assumes - score every document.

There are two targets, each trained so: low quality and toxic.  quality = (1 - p(low)) (1 - p(toxic)); a document is
kept if neither probability reaches REJECT.

Training uses at most LABELLED labelled and UNLABELLED other documents, those whose ids have the least hashes; scoring
reads every word of every text.

Defined cases: null text counts as empty; null metadata is a value of its own; a document with several labels counts as bad if one
of them says so; labels of unknown documents and null labels are left out; of rows with one id the least text is learned from, rows without id are
scored only; with no labels, or one class only, a target's probability is its base rate (0 without labels); repeated rows
stay; extra columns are dropped where a result names its columns; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, small, staged, table

LABELLED = 6000
UNLABELLED = 2000
ROUNDS = 3
CONFIDENT = 0.95
EXCHANGED = 400
REJECT = 0.5
STEMS = 3000
_ODD = re.compile(r"[^\w\s]{2,}(?=\s|$)")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_LEVELS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)


def stems(word: str) -> tuple[int, ...]:
    """Hashes of the word's prefixes."""
    w = _EDGE.sub("", word)
    return tuple({zlib.crc32(f"{k}{w[:k]}".encode()) for k in (4, 5, 6) if len(w) >= k} | ({zlib.crc32(f"={w}".encode())} if w else set()))


def shape(text: str, words: list[str]) -> list[float]:
    """Shares that describe a text as a whole, each at several levels, and its length."""
    n = len(words) or 1
    lines = [x for x in text.split("\n") if x]
    shares = [
        len(_ODD.findall(text)) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(words)) / n if n >= 8 else 0.0,
        sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isdigit, words)) / n,
        min(1.0, n / len(text) * 2) if text else 0.0,
    ]
    return [*(float(s >= level) for s in shares for level in _LEVELS), *shares, min(1.0, np.log1p(n) / 10), float(not words)]


def metadata(lang: str | None, source: str | None, length: int) -> list[int]:
    """Hashes of what is known without reading."""
    return [zlib.crc32(x.encode()) for x in (f"lang={lang}", f"source={source}", f"length={int(np.log2(length + 1))}", "bias")]


class Rows:
    """Sparse rows of ones: positions of columns, and the row of each."""

    def __init__(self, lists: tuple[np.ndarray, np.ndarray], columns: np.ndarray):
        """lists: (where each row begins, names of all rows); columns: the names that count, sorted."""
        begins, names = lists
        at, row = [], []
        for k in range(0, len(names), 1 << 20):
            some = names[k : k + (1 << 20)]
            place = np.searchsorted(columns, some)
            have = np.flatnonzero(columns[np.minimum(place, len(columns) - 1)] == some) if len(columns) else np.zeros(0, np.int64)
            at.append(place[have])
            row.append(np.searchsorted(begins, have + k, "right") - 1)
        self.at, self.row = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, row))
        self.n, self.width = len(begins) - 1, len(columns)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=r[self.row], minlength=self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Logistic regression on sparse ones and dense columns, fitted by Adam; fixed steps, so equal data give equal models."""

    def __init__(self, sparse: Rows, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, decay: float = 2e-4):
        self.w, self.d, self.b = np.zeros(sparse.width), np.zeros(dense.shape[1]), 0.0
        total = weight.sum()
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.w, self.d, np.zeros(1))]
        for step in range(1, steps + 1):
            r = weight * (y - _sigmoid(self.score(sparse, dense))) / total
            grads = (sparse.back(r) - decay * self.w, dense.T @ r - decay * self.d, np.array([r.sum()]))
            moves = []
            for g, (m, v) in zip(grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                moves.append(0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
            self.w, self.d, self.b = self.w + moves[0], self.d + moves[1], self.b + float(moves[2][0])

    def score(self, sparse: Rows, dense: np.ndarray) -> np.ndarray:
        return sparse.times(self.w) + dense @ self.d + self.b


def _calibrated(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, bias) of a logistic curve over the scores, by damped Newton steps with a weak prior.

    The slope is not negative: a view that would only help upside down says nothing.
    """
    x = np.column_stack([np.clip(scores, -20, 20), np.ones(len(y))])
    prior = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.25 * ((w - prior) ** 2).sum())

    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ w)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), x.T @ (y - p) - 0.5 * (w - prior))
        step = 1.0
        while step > 1e-4 and loss(w + step * move) > loss(w):
            step /= 2
        w = w + step * move
    if w[0] < 0:
        return 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return float(w[0]), float(w[1])


def _chosen_stems(lists: tuple[np.ndarray, np.ndarray], rows: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Stems that tell the classes of these rows apart, sorted: by the size of the log-odds against its error, from five documents on."""
    begins, every = lists
    mine = np.concatenate([every[:0], *(every[begins[i] : begins[i + 1]] for i in rows)])
    names, n_all = np.unique(mine, return_counts=True)
    names = names[n_all >= 5]
    kept = Rows((np.concatenate([[0], np.cumsum(np.diff(begins)[rows])]), mine), names)
    bad, good = kept.back(y), kept.back(1 - y)
    n, m = y.sum(), (1 - y).sum()
    odds = np.log((bad + 0.5) / (n - bad + 0.5)) - np.log((good + 0.5) / (m - good + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(names[best[z[best] > 2.5]])


def _surest(p: np.ndarray, pool: np.ndarray, base: float, confident: float, most: int) -> dict[int, float]:
    """Labels of the documents in the pool that p is most confident about, each class in proportion."""
    out = {}
    for label, q, share in ((1.0, p[pool], base), (0.0, 1 - p[pool], 1 - base)):
        top = np.argsort(-q, kind="stable")[: math.ceil(most * share)]
        out |= {int(pool[i]): label for i in top if q[i] >= confident}
    return out


class Target:
    """What co-training learned about one target.

    exchanged: for each round, how many bad and good labels the text view and the metadata view gave to the other.
    """

    def __init__(self, y: np.ndarray, labelled: np.ndarray, texts: tuple, shapes: np.ndarray, metas: tuple, rounds: int = ROUNDS, confident: float = CONFIDENT, most: int = EXCHANGED):
        self.columns = self.meta_columns = np.zeros(0, np.int64)
        known = np.flatnonzero(labelled)
        self.base = float(y[known].mean()) if len(known) else 0.0
        self.text = None
        self.exchanged: list[tuple[tuple[int, int], tuple[int, int]]] = []
        if len(known) < 10 or y[known].sum() in (0, len(known)):
            return
        held = known[::4]  # neither view learns from these: they calibrate
        learn = np.setdiff1d(known, held)
        if y[learn].sum() in (0, len(learn)):
            return
        self.columns = _chosen_stems(texts, learn, y[learn], STEMS)
        self.meta_columns = np.unique(np.concatenate([metas[1][metas[0][i] : metas[0][i + 1]] for i in learn]))
        views = [(Rows(texts, self.columns), np.zeros((len(y), 0))), (Rows(metas, self.meta_columns), shapes)]
        pool = np.flatnonzero(~labelled)
        given: list[dict[int, float]] = [{}, {}]  # to each view by the other
        for turn in range(rounds + 1):
            models, scores = [], []
            for (sparse, dense), extra in zip(views, given):
                weight, target = np.zeros(len(y)), y.copy()
                weight[learn] = 1.0
                for i, label in extra.items():
                    weight[i], target[i] = 0.5, label
                models.append(Logistic(sparse, dense, target, weight))
                scores.append(models[-1].score(sparse, dense))
            curves = [_calibrated(s[held], y[held]) for s in scores]
            if turn < rounds:
                told = []
                for v in (0, 1):
                    p = _sigmoid(np.clip(scores[v], -20, 20) * curves[v][0] + curves[v][1])
                    new = pool[~np.isin(pool, np.array(list(given[1 - v]), dtype=np.int64))]
                    told.append(_surest(p, new, self.base, confident, most))
                for v in (0, 1):
                    given[1 - v] |= told[v]
                self.exchanged.append(tuple((int(sum(x.values())), len(x) - int(sum(x.values()))) for x in told))
        self.text, self.meta = models
        # calibrated views add up as evidence: log-odds of both, less the odds that both start from
        odds = math.log((y[held].sum() + 0.5) / (len(held) - y[held].sum() + 0.5))
        self.curve = np.array([curves[0][0], curves[1][0], curves[0][1] + curves[1][1] - odds])

    def probability(self, texts: list, shapes: np.ndarray, metas: tuple) -> np.ndarray:
        """texts: positions among the chosen columns; metas as in training."""
        if self.text is None:
            return np.full(len(texts), self.base)
        a = np.array([self.text.w[x].sum() if len(x) else 0.0 for x in texts]) + self.text.b
        b = self.meta.score(Rows(metas, self.meta_columns), shapes)
        x = np.clip(np.column_stack([a, b]), -20, 20)
        return _sigmoid(x @ self.curve[:2] + self.curve[2])


def flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """(where each list begins, what all lists hold)."""
    return np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), np.fromiter(chain.from_iterable(lists), dtype=np.int64)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of sampled documents; id and labels go through.  Stems are 32-bit numbers, kept as signed ones."""
    for batch in small(batches):
        texts, langs, sources = (batch.column(k).to_pylist() for k in (0, 1, 2))
        found, shapes, metas = [], [], []
        for text, lang, source in zip(texts, langs, sources):
            text = text or ""
            words = text.split()
            found.append(np.array(sorted({s for w in set(text.lower().split()) for s in stems(w)}), dtype=np.uint32).view(np.int32))
            shapes.append(shape(text, words))
            metas.append(metadata(lang, source, len(text)))
        yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), batch.column(5), pa.array(found, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float64())), pa.array(metas, pa.list_(pa.int64()))], names=["doc", "low", "toxic", "stems", "shape", "meta"])


def sample(docs: DataFrame, labels: DataFrame, labelled: int, unlabelled: int) -> DataFrame:
    """(_doc, low, toxic) of at most `labelled` labelled documents and at most `unlabelled` others, whose labels are null: the ids of least hash."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max((F.col("quality") == 0).cast("int")).alias("low"), F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("_doc")).where("_doc is not null").distinct()
    first = known.join(ids, "_doc", "left_semi").orderBy(F.xxhash64("_doc"), "_doc").limit(labelled)
    others = ids.join(known, "_doc", "left_anti").orderBy(F.xxhash64("_doc"), "_doc").limit(unlabelled)
    return first.unionByName(others.select("_doc", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("toxic")))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, rounds: int = ROUNDS, confident: float = CONFIDENT) -> dict[str, Target]:
    """The targets `low` and `toxic`, learned from a sample of bounded size."""
    some = F.broadcast(staged(sample(docs, labels, labelled, unlabelled), "sample"))  # at most labelled + unlabelled rows of 16 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.struct(F.col("text").alias("_text"), F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source")).alias("_row"))
    one = rows.join(some.select("_doc"), "_doc", "left_semi").groupBy("_doc").agg(F.min("_row").alias("_row")).join(some, "_doc")
    sampled = one.select("_row._text", "_row._lang", "_row._source", "_doc", "low", "toxic").mapInArrow(_described, "doc long, low int, toxic int, stems array<int>, shape array<double>, meta array<long>")
    found = sampled.toArrow().combine_chunks().sort_by("doc")
    is_known = found["low"].is_valid().to_numpy()
    width = len(shape("", []))

    def lists(column: str) -> tuple[np.ndarray, np.ndarray]:
        array = found[column].combine_chunks()
        return array.offsets.to_numpy().astype(np.int64) - array.offsets[0].as_py() if len(array) else np.zeros(1, np.int64), array.flatten().to_numpy(zero_copy_only=False)

    begins, numbers = lists("stems")
    texts, metas = (begins, numbers.view(np.uint32)), lists("meta")
    shapes = lists("shape")[1].reshape(-1, width)
    return {c: Target(found[c].fill_null(0).to_numpy().astype(np.float64), is_known, texts, shapes, metas, rounds, confident) for c in ("low", "toxic")}


class _Chosen(dict):
    """word -> its stems among the columns of each target, as a tuple of tuples; mostly None."""

    most = 300_000

    def __init__(self, columns: list[np.ndarray]):
        self.columns = [{f: k for k, f in enumerate(c.tolist())} for c in columns]

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        names = stems(word)
        found = tuple(tuple(c[f] for f in names if f in c) for c in self.columns)
        self[word] = found if any(found) else None
        return self[word]


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets = list(sent.value.values())
        chosen = _Chosen([t.columns for t in targets])
        for batch in small(batches):
            langs, sources = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found, shapes, metas = [[] for _ in targets], [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                words = text.split()
                hits = [x for x in map(chosen.__getitem__, set(text.lower().split())) if x]
                for t in range(len(targets)):
                    found[t].append(sorted({f for x in hits for f in x[t]}))
                shapes.append(shape(text, words))
                metas.append(metadata(langs[k], sources[k], len(text)))
            dense = np.array(shapes, dtype=np.float64).reshape(len(shapes), -1 if shapes else len(shape("", [])))
            p = [t.probability(f, dense, flat(metas)) for t, f in zip(targets, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[1:], pa.array(p[0], pa.float64()), pa.array(p[1], pa.float64())], names=[*batch.schema.names, "_low", "_toxic"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars with _low and _toxic, the probabilities of the two targets."""
    base = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "n_chars")
    model = Sent(docs.sparkSession, train(docs, labels))
    fields = ", ".join(f"{c} {t}" for c, t in base.dtypes)
    return base.mapInArrow(_scored(model), f"{fields}, _low double, _toxic double")


def is_kept():
    return (F.col("_low") < REJECT) & (F.col("_toxic") < REJECT)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are probably of low quality or toxic."""
    return score(docs, labels).where(is_kept()).select("doc_id", "text", "lang", "source", "n_chars")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.col("_low").alias("p_low"), F.col("_toxic").alias("p_toxic"), ((1 - F.col("_low")) * (1 - F.col("_toxic"))).alias("quality"), is_kept().alias("keep"))
