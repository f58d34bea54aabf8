"""Language of words and documents: a linear-chain conditional random field.

Each word has features: its affixes, its character n-grams, and itself where it is in the lexicon learned with the model.
Weights of features and of transitions between languages are fitted by the likelihood of label sequences; some training sequences
are spliced from documents of different languages, so that transitions learn what code-switching looks like.
Forward-backward over the whole text gives each word's distribution; a document's language has the greatest share of words.

Training uses at most PER_LANG documents a language, those of the least hash of the id, and SEQUENCE consecutive words of each,
from the TRAINED characters in its middle; every language that occurs is learned, at 256 KB of weights each.  Prediction uses every word of every text.  Forward-backward runs blockwise: blocks of a text give transfer matrices, these are chained,
then all blocks are solved in step, which gives the same result as one chain from end to end.

Defined cases: null text, or text without a letter, is `und` with score 0; without any training document everything
is `und`; ties go to the language that sorts first; repeated rows stay; extra columns are dropped; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Sent, crc_mod, in_batches, mixed, small_or, table
from .exchange import run_hashes

PER_LANG = 600
SEQUENCE = 48
#: Characters of a training text from whose middle its sequence comes.
TRAINED = 20_000
BUCKETS = 1 << 16
LEXICON = 2000
STEPS = 60
BLOCK = 64


def letters(word: str) -> str:
    """The word from its first letter to its last, lower-cased; empty if it has none."""
    w = word.lower()
    if w.isalpha():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalpha():
        a += 1
    while b > a and not w[b - 1].isalpha():
        b -= 1
    return w[a:b]


def lexicon_of(words: list[str]) -> np.ndarray:
    """Sorted hashes of the lexicon's words."""
    codes, starts, ends = _codes(words)
    return np.unique(run_hashes(codes, starts, ends)) if words else np.zeros(0, np.uint64)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words with a mark between them, where each word starts, where it ends)."""
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    marks = np.flatnonzero(codes == 10)
    return codes, marks[:-1] + 1, marks[1:]


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all features of all words, the word of each): prefixes and suffixes, n-grams with edges, the word itself if in the lexicon.

    words: not empty, without line breaks.  One pass over the characters of all words; a long
    word, or a text without blanks, counts with every character.
    """
    codes, starts, ends = _codes(words)
    size = ends - starts
    numbers, owners = [], []

    def add(kind: int, hashes: np.ndarray, of: np.ndarray) -> None:
        numbers.append((mixed(hashes + np.uint64(kind << 40)) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(of)

    every = np.arange(len(words))
    for k in (1, 2, 3):
        fits = np.flatnonzero(size >= k)
        add(k, run_hashes(codes, starts[fits], starts[fits] + k), fits)
        add(3 + k, run_hashes(codes, ends[fits] - k, ends[fits]), fits)
    for k in (2, 3):  # the marks around a word are its edges
        count = size + 3 - k
        of = np.repeat(every, np.maximum(count, 0))
        at = np.arange(len(of)) - np.repeat(np.cumsum(np.maximum(count, 0)) - np.maximum(count, 0), np.maximum(count, 0)) + starts[of] - 1
        gram = codes[at]
        for j in range(1, k):
            gram = gram * np.uint64(0x110000) + codes[at + j]
        add(6 + k, gram, of)
    if len(lexicon):
        whole = run_hashes(codes, starts, ends)
        at = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == whole)
        add(10, whole[known], known)
    return np.concatenate(numbers), np.concatenate(owners)


def solve(potentials: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of each position, log-normaliser of each sequence) by forward-backward.

    potentials: (positions of all sequences, labels), positive; transitions: (labels, labels), positive.  Before the first
    word all labels are alike.
    """
    n, labels = potentials.shape
    scale = potentials.max(1, keepdims=True)
    e = potentials / scale
    log = np.log(scale[:, 0])
    begins = np.concatenate([[0], np.cumsum(lengths)])
    per = -(-lengths // block)
    first = np.concatenate([[0], np.cumsum(per)])  # of each sequence's blocks
    nb = int(first[-1])
    of = np.repeat(np.arange(len(lengths)), per)
    index = np.arange(nb) - first[:-1][of]
    start = begins[:-1][of] + index * block
    size = np.minimum(block, begins[1:][of] - start)
    order = np.argsort(-size, kind="stable")
    live = [int(np.searchsorted(-size[order], -t, "left")) for t in range(block)]  # blocks with more than t positions

    norm = np.zeros(nb)
    if len(per) and per.max(initial=0) > 1:
        many = np.zeros(nb, dtype=bool)
        many[:] = per[of] > 1
        m = np.tile(np.eye(labels), (nb, 1, 1))
        for t in range(block):
            k = order[: live[t]]
            k = k[many[k]]
            if not len(k):
                break
            x = (m[k] @ transitions) * e[start[k] + t][:, None, :]
            total = x.sum((1, 2), keepdims=True)
            m[k] = x / total
    left = np.full((nb, labels), 1.0 / labels)  # before each block
    right = np.ones((nb, labels))  # after each block
    for j in range(1, int(per.max(initial=0))):
        k = first[:-1][per > j] + j
        v = np.einsum("bi,bij->bj", left[k - 1], m[k - 1])
        left[k] = v / v.sum(1, keepdims=True)
        k = first[1:][per > j] - 1 - j
        v = np.einsum("bij,bj->bi", m[k + 1], right[k + 1])
        right[k] = v / v.sum(1, keepdims=True)
    alpha = np.empty((n, labels))
    a = left
    a = a.copy()
    for t in range(block):
        k = order[: live[t]]
        if not len(k):
            break
        at = start[k] + t
        x = (a[k] @ transitions) * e[at]
        total = x.sum(1, keepdims=True)
        a[k] = alpha[at] = x / total
        norm[k] += np.log(total[:, 0])
    b = right.copy()
    out = np.empty((n, labels))
    for t in range(block - 1, -1, -1):
        k = order[: live[t]]
        at = start[k] + t
        x = alpha[at] * b[k]
        out[at] = x / x.sum(1, keepdims=True)
        y = (e[at] * b[k]) @ transitions.T
        b[k] = y / y.sum(1, keepdims=True)
    logs = np.bincount(of, weights=norm, minlength=len(lengths)) + np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=log, minlength=len(lengths))
    return out, logs


class Model:
    """Labels, lexicon (sorted hashes), weights of features (BUCKETS, labels), weights of transitions (labels, labels)."""

    def __init__(self, labels: list[str], lexicon: np.ndarray, weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.lexicon, self.weights, self.transitions = labels, lexicon, weights, transitions

    def potentials(self, words: list[str]) -> np.ndarray:
        """(words, labels): how well each label fits each word; words are not empty."""
        numbers, owners = features(words, self.lexicon)
        scores = np.stack([np.bincount(owners, weights=self.weights[numbers, j], minlength=len(words)) for j in range(len(self.labels))], 1)
        return np.exp(scores - scores.max(1, keepdims=True))


def _sequences(examples: list[tuple[str, str]], rng: np.random.Generator) -> list[list[tuple[str, str]]]:
    """Labelled words: one run of each text, and as many spliced from runs of two or three texts."""
    runs = []
    for lang, text in examples:
        words = [w for w in map(letters, text.split()) if w]
        if words:
            at = int(rng.integers(0, max(1, len(words) - SEQUENCE + 1)))
            runs.append([(w, lang) for w in words[at : at + SEQUENCE]])
    out = list(runs)
    for _ in range(len(runs)):
        picked = rng.integers(0, len(runs), int(rng.integers(2, 4)))
        out.append([x for k in picked for x in runs[k][: int(rng.integers(4, 20))]])
    return out


def fit(examples: list[tuple[str, str]], steps: int = STEPS, seed: int = 5) -> Model:
    """A model of (lang, text) examples, fitted by Adam on the conditional likelihood."""
    labels = sorted({lang for lang, _ in examples})
    number = {x: k for k, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    sequences = _sequences(sorted(examples), rng)
    lexicon = lexicon_of([w for lang in labels for w, _ in Counter(w for s in sequences for w, x in s if x == lang).most_common(LEXICON)])
    words = sorted({w for s in sequences for w, _ in s})
    if not words:
        return Model(labels, lexicon, np.zeros((BUCKETS, len(labels)), np.float32), np.zeros((len(labels),) * 2))
    row = {w: k for k, w in enumerate(words)}
    flat, owner = features(words, lexicon)
    used, flat = np.unique(flat, return_inverse=True)
    at = np.array([row[w] for s in sequences for w, _ in s])
    gold = np.array([number[x] for s in sequences for _, x in s])
    lengths = np.array([len(s) for s in sequences])
    n, k = len(at), len(labels)
    first = np.zeros(n, dtype=bool)
    first[np.concatenate([[0], np.cumsum(lengths)])[:-1]] = True
    follows = np.flatnonzero(~first)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[follows - 1], gold[follows]), 1)
    w, t = np.zeros((len(used), k)), np.zeros((k, k))
    moments = [np.zeros_like(x) for x in (w, w, t, t)]
    for step in range(1, steps + 1):
        scores = np.stack([np.bincount(owner, weights=w[flat, j], minlength=len(words)) for j in range(k)], 1)[at]
        e = np.exp(scores - scores.max(1, keepdims=True))
        trans = np.exp(t)
        marginal, _ = solve(e, trans, lengths)
        miss = -marginal
        miss[np.arange(n), gold] += 1
        by_word = np.stack([np.bincount(at, weights=miss[:, j], minlength=len(words)) for j in range(k)], 1)
        gw = np.stack([np.bincount(flat, weights=by_word[owner, j], minlength=len(used)) for j in range(k)], 1) / n - 1e-5 * w
        # expected transitions, from marginals of neighbours under the model
        pair = (marginal[follows - 1] / np.maximum(marginal[follows - 1].sum(1, keepdims=True), 1e-12))[:, :, None] * trans[None] * (marginal[follows] / np.maximum(marginal[follows - 1] @ trans, 1e-12))[:, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
        gt = (seen - pair.sum(0)) / n - 1e-5 * t
        for x, g, m, v in ((w, gw, moments[0], moments[1]), (t, gt, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    whole = np.zeros((BUCKETS, k), dtype=np.float32)
    whole[used] = w
    return Model(labels, lexicon, whole, t)


class _Potentials(dict):
    """word -> row of a table of potentials that grows; starts over when it is full.  Row 0 is for words without letters."""

    most = 300_000

    def __init__(self, model: Model):
        self.model = model
        self.table = np.ones((1, len(model.labels)))

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word; new words are described together."""
        new = [w for w in set(words) if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            self.table = self.table[:1]
            new = list(set(words))
        stripped = [letters(w) for w in new]
        lettered = [x for x in stripped if x]
        if lettered:
            self.table = np.concatenate([self.table, self.model.potentials(lettered)])
        row = len(self.table) - len(lettered)
        for w, x in zip(new, stripped):
            self[w] = row if x else 0
            row += bool(x)
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def mark_words(texts: list[str], model: Model, held: _Potentials | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of each word, which words have letters, number of words of each text)."""
    held = held if held is not None else _Potentials(model)
    words = [t.split() for t in texts]
    lengths = np.array([len(x) for x in words], dtype=np.int64)
    rows = held.rows(list(chain.from_iterable(words)))
    if not len(rows):
        return np.zeros((0, len(model.labels))), np.zeros(0, bool), lengths
    marginal, _ = solve(held.table[rows], np.exp(model.transitions), lengths[lengths > 0])
    return marginal, rows > 0, lengths


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        held = _Potentials(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if model.labels:
                for some in in_batches(range(len(texts)), lambda i: len(texts[i]), 1_500_000):
                    marginal, lettered, lengths = mark_words([texts[i] for i in some], model, held)
                    marginal = marginal * lettered[:, None]
                    owner = np.repeat(np.arange(len(some)), lengths)
                    total = np.stack([np.bincount(owner, weights=marginal[:, j], minlength=len(some)) for j in range(len(model.labels))], 1)
                    for k, i in enumerate(some):
                        if (whole := total[k].sum()) > 0:
                            best = int(np.argmax(total[k]))
                            lang[i], score[i] = model.labels[best], float(min(1.0, total[k][best] / whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["_id", "held_out", "lang_pred", "score"])

    return run


def sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """At most `per_lang` (lang, text) a language, those of the least hash of the id; texts to TRAINED characters, from the middle.

    Rows whose hash is far above what is needed go first, by the language's count; the others are ranked.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 53)).alias("_h"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    counts = rows.groupBy("_lang").agg(F.count("*").alias("_count"), F.min("_h").alias("_least"))
    near = (F.col("_h") == F.col("_least")) | (F.col("_h") <= F.lit(4.0 * per_lang * (1 << 53)) / F.col("_count"))
    middle = F.expr(f"substring(_text, greatest(1, cast(length(_text) / 2 as int) - {TRAINED // 2}), {TRAINED})")
    some = rows.join(small_or(counts, 10_000), "_lang").where(near).select("_lang", "_h", middle.alias("_text"))
    rank = F.row_number().over(W.partitionBy("_lang").orderBy("_h", "_text"))
    return sorted((r[0], r[1]) for r in some.select("_lang", "_text", rank.alias("_rank")).where(F.col("_rank") <= per_lang).select("_lang", "_text").toLocalIterator())


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of every row; the model learns from rows where `learn` holds."""
    spark = docs.sparkSession
    examples = sample(docs, learn, id_col, text_col, lang_col)
    model = fit(examples) if examples else Model([], np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros((0, 0)))
    df = docs.select(F.col(id_col).cast("long").alias("_id"), (~F.coalesce(learn, F.lit(False))).alias("held_out"), F.col(text_col).alias("_text"))
    found = df.mapInArrow(_predict(Sent(spark, model)), "_id long, held_out boolean, lang_pred string, score double")
    return found.select(F.col("_id").alias(id_col), "held_out", "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, crc_mod(F.col("doc_id"), 4) != 2)
