"""LM scoring with a weighted backoff automaton over n-grams of up to three tokens.

Tokens: A-Z lower-cased, then words parted by blanks and \\x09 to \\x0d, then one end.  Each order is smoothed with the one
below it (Dirichlet): p(w | u v) = (c(u v w) + K3 p(w | v)) / (c(u v) + K3), p(w | v) = (c(v w) + K2 p(w)) / (c(v) + K2),
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).  As an automaton: the state without context, one state for each word, and one for
each pair of words seen STATE_MIN times or more in training.  A state has an arc for each word that followed it, with its
log-probability, to the longest state that ends in that word; where it has none, its failure arc leads to the state of
its shorter context and weighs log K / (c + K).  The state without context has an arc for every word, known or not.  A
text runs once from left to right: the state is carried from token to token, failure arcs are followed until a state has an arc, and
weights add up.  Probabilities of a state add up to one over the known words and one unknown.

Counts of words, pairs and triples cover all training documents; they are added up by an exchange of packed arrays
between shards of documents and buckets of hashes (exchange.py), and each shard gets back the counts of what its own documents hold.  No
model is collected anywhere: a shard builds that part of the automaton that its texts can reach, and the model grows with the
corpus.  Triples of pairs that are no state are no arcs, so they are not sent.

Defined cases: null text counts as empty (one end token); a null id counts as empty text for the split; repeated rows
count each; extra columns are dropped; an empty table gives an empty result; without training documents N is 0 and every
token has probability 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, mixed, staged, table, text_bytes
from .exchange import ANSWER_DDL, BUCKET_BYTES, MESSAGE, MESSAGE_DDL, added, deal, messages, narrow, received, unpacked, widen, word_hashes

#: Weight of the lower order, in tokens, for contexts of one word and of two.
K = (20.0, 5.0)
#: How often a pair occurs in training to be a state.
STATE_MIN = 2
SHARD_BYTES = 6_000_000
#: Texts run side by side in stretches of so many tokens; the state at a stretch's start is that after its two tokens before.
STRETCH = 192
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_END, _START = np.uint64(0xE7D), np.uint64(0x57A)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS, _PAIRS, _TRIPLES = 1, 2, 3


class Tokens:
    """Tokens of some texts, one after the other: hashes of words, and of pairs and triples that end with each token."""

    def __init__(self, texts: list[bytes]):
        hashes, counts = word_hashes([t.translate(_LOWER) for t in texts])
        lengths = counts + 1
        self.limits = np.concatenate([[0], np.cumsum(lengths)])
        last = self.limits[1:] - 1
        self.token = np.full(int(self.limits[-1]), _END, dtype=np.uint64)
        inside = np.ones(len(self.token), dtype=bool)
        inside[last] = False
        self.token[inside] = hashes
        before = np.concatenate([[_START], self.token[:-1]]) if len(texts) else self.token
        before[self.limits[:-1]] = _START
        self.before = before
        self.pair = mixed(before * _MIX + self.token)
        self.lengths = lengths
        self.second = np.ones(len(self.token), dtype=bool)  # tokens with a pair before them
        self.second[self.limits[:-1]] = False

    def triples(self, at: np.ndarray) -> np.ndarray:
        """The hash of the pair before and the token, of the tokens at these places."""
        return mixed(mixed(self.pair[at - 1]) * _MIX + self.token[at])

    def of(self, marks: np.ndarray) -> np.ndarray:
        """A mark of each text, for each of its tokens."""
        return np.repeat(marks, self.lengths)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct words and the start, place of each token's word among them)."""
        distinct, at = np.unique(np.concatenate([self.token, [_START]]), return_inverse=True)
        return distinct, at[: len(self.token)]


def _counted(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, how many of each are counted)."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=counted, minlength=len(distinct)).astype(np.int64)


def _learned(docs: pa.Table, t: Tokens) -> np.ndarray:
    return t.of(np.array(docs["_learn"].to_pylist(), dtype=bool))


def _send(buckets: int):
    def send(docs: pa.Table) -> pa.Table:
        """Words and pairs of a shard; the start is counted among the words, once a text."""
        t = Tokens(as_bytes(docs["_text"].combine_chunks()))
        learned, shard = _learned(docs, t), docs["_shard"][0].as_py()
        words = np.concatenate([t.token, np.full(len(t.lengths), _START)])
        marks = np.concatenate([learned, learned[t.limits[:-1]]])
        return pa.concat_tables([messages(shard, kind, *_counted(keys, m), buckets) for kind, keys, m in ((_WORDS, words, marks), (_PAIRS, t.pair, learned))])

    return send


def _arcs(t: Tokens, pair_at: np.ndarray, pair_counts: np.ndarray, least: int) -> np.ndarray:
    """Places of the tokens whose pair before is a state; pair_at: the place of each token's pair among the distinct ones."""
    state = (pair_counts >= least)[pair_at]
    at = np.flatnonzero(t.second)
    return at[state[at - 1]]


def _send_triples(buckets: int, least: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return MESSAGE.empty_table()
        t = Tokens(as_bytes(docs["_text"].combine_chunks()))
        at = _arcs(t, np.unique(t.pair, return_inverse=True)[1], received(answers, _PAIRS), least)
        return messages(docs["_shard"][0].as_py(), _TRIPLES, *_counted(t.triples(at), _learned(docs, t)[at]), buckets)

    return send


def _sum(bucket: pa.Table) -> pa.Table:
    """Answers each key's total; shard -1 gets [distinct words counted, tokens counted]."""
    out = []
    for kind in (_WORDS, _PAIRS, _TRIPLES):
        rows = bucket.filter(pa.compute.equal(bucket["kind"], kind))
        if not rows.num_rows:
            continue
        keys = [unpacked(x) for x in rows["keys"].to_pylist()]
        total, aligned = added(keys, [widen(x) for x in rows["counts"].to_pylist()])
        out.append(pa.table({"shard": rows["shard"], "bucket": rows["bucket"], "kind": rows["kind"], "values": pa.array([narrow(x) for x in aligned], pa.binary())}))
        if kind == _WORDS:
            every = np.unique(np.concatenate(keys))
            total = total[every != _START]
            whole = np.array([np.count_nonzero(total), total.sum()], dtype="<i8").tobytes()
            out.append(pa.table({"shard": pa.array([-1], pa.int32()), "bucket": rows["bucket"][:1], "kind": pa.array([0], pa.int8()), "values": pa.array([whole], pa.binary())}))
    return pa.concat_tables(out).combine_chunks()


class Automaton:
    """States, arcs and failure arcs; weights are log10.

    Words have numbers from 0; state 0 is without context, state 1 + w that of word w, the states of pairs follow.  Arcs
    are in order of state and word; state 0 has one for each word, root[w], to 1 + w.
    """

    def __init__(self, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray, n: int, v: int, k: tuple[float, float], least: int):
        """counts: of each word as a context and as a token; pairs: (before, word); triples: (pair, the pair that its last two words are)."""
        size = len(counts)
        k2, k3 = k
        self.size = size
        p1 = (counts + 0.5) / (n + 0.5 * (v + 1)) if n else np.ones(size)
        p2 = (pair_counts + k2 * p1[pairs[:, 1]]) / (counts[pairs[:, 0]] + k2)
        p3 = (triple_counts + k3 * p2[triples[:, 1]]) / (pair_counts[triples[:, 0]] + k3)
        whole = np.flatnonzero(pair_counts >= least)
        state = 1 + pairs[:, 1]  # the longest state that ends in each pair
        state[whole] = 1 + size + np.arange(len(whole))
        seen, seen3 = pair_counts > 0, triple_counts > 0
        source = np.concatenate([1 + pairs[seen, 0], state[triples[seen3, 0]]])
        word = np.concatenate([pairs[seen, 1], pairs[triples[seen3, 1], 1]])
        arcs = source * size + word
        order = np.argsort(arcs)
        self.arcs = np.concatenate([arcs[order], [np.iinfo(np.int64).max]])  # the last is no arc
        self.weights = np.log10(np.concatenate([p2[seen], p3[seen3]]))[order]
        self.targets = np.concatenate([state[seen], state[triples[seen3, 1]]])[order]
        self.root = np.log10(p1)
        self.failure = np.concatenate([np.zeros(1 + size, np.int64), 1 + pairs[whole, 1]])
        self.failure_weight = np.concatenate([[0.0], np.log10(k2 / (counts + k2)), np.log10(k3 / (pair_counts[whole] + k3))])

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after a word, weights added): failure arcs are followed until a state has an arc for the word."""
        weight, after = np.zeros(len(states)), np.empty(len(states), dtype=np.int64)
        left = np.arange(len(states))
        while len(left):
            rooted = states[left] == 0
            at = left[rooted]
            weight[at] += self.root[words[at]]
            after[at] = 1 + words[at]
            left = left[~rooted]
            sought = states[left] * self.size + words[left]
            arc = np.searchsorted(self.arcs, sought)
            has = self.arcs[arc] == sought
            at, arc = left[has], arc[has]
            weight[at] += self.weights[arc]
            after[at] = self.targets[arc]
            left = left[~has]
            weight[left] += self.failure_weight[states[left]]
            states = states.copy()
            states[left] = self.failure[states[left]]
        return after, weight

    def run(self, words: np.ndarray, limits: np.ndarray, start: int, stretch: int = STRETCH) -> np.ndarray:
        """The weight of each text (words[limits[i]:limits[i + 1]], not empty) from the state of word `start`."""
        lengths = np.diff(limits)
        per = -(-lengths // stretch)
        text = np.repeat(np.arange(len(lengths)), per)
        index = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        at = limits[:-1][text] + index * stretch
        size = np.minimum(stretch, limits[1:][text] - at)
        order = np.argsort(-size, kind="stable")
        text, index, at, size = text[order], index[order], at[order], size[order]
        states = np.full(len(text), 1 + start, dtype=np.int64)
        inner = np.flatnonzero(index > 0)
        states[inner] = 0
        for back in (2, 1):
            states[inner] = self.step(states[inner], words[at[inner] - back])[0]
        total = np.zeros(len(text))
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t, "left"))
            states, weight = self.step(states[:live], words[at[:live] + t])
            total[:live] += weight
        return np.bincount(text, weights=total, minlength=len(lengths))


def _per_text(values: np.ndarray, limits: np.ndarray) -> list:
    return np.add.reduceat(values, limits[:-1]).tolist() if len(values) else []


_OUT = pa.schema([("_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_OUT_DDL = "_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(n: int, v: int, k: tuple[float, float], least: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _OUT.empty_table()
        t = Tokens(as_bytes(docs["_text"].combine_chunks()))
        words, word_at = t.words()
        start = int(np.searchsorted(words, _START))
        _, first, pair_at = np.unique(t.pair, return_index=True, return_inverse=True)
        pair_counts = received(answers, _PAIRS)
        at = _arcs(t, pair_at, pair_counts, least)
        _, one = np.unique(t.triples(at), return_index=True)
        end = at[one]  # a place of each triple's last token
        before = np.concatenate([[start], word_at[:-1]])
        before[t.limits[:-1]] = start
        model = Automaton(received(answers, _WORDS), np.stack([before[first], word_at[first]], 1), pair_counts, np.stack([pair_at[end - 1], pair_at[end]], 1), received(answers, _TRIPLES), n, v, k, least)
        base = model.root[word_at]
        known = (received(answers, _WORDS)[word_at] > 0).astype(np.int64)
        columns = [docs["_id"].cast(pa.int64()), pa.compute.invert(docs["_learn"]), pa.array(t.lengths, pa.int64()), pa.array(_per_text(known, t.limits), pa.int64()), pa.array(_per_text(base, t.limits), pa.float64()), pa.array(model.run(word_at, t.limits, start), pa.float64())]
        return pa.table(columns, schema=_OUT)

    return score


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", k: tuple[float, float] = K, least: int = STATE_MIN, shards: int | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; the model learns from rows where `learn` holds."""
    df = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"))
    size = text_bytes(df, "_text")
    count = shards or max(8, -(-size // SHARD_BYTES))
    buckets = max(8, -(-size // BUCKET_BYTES))
    by_shard = deal(df, count, ("_id", "_id"), ("_text", "_text"), ("_learn", "_learn")).groupBy("_shard")
    few = staged(by_shard.applyInArrow(_send(buckets), MESSAGE_DDL).groupBy("bucket").applyInArrow(_sum, ANSWER_DDL), "counts")
    v = n = 0
    for row in few.where("shard = -1").select("values").toLocalIterator():  # one row a bucket
        a, b = np.frombuffer(bytes(row[0]), "<i8").tolist()
        v, n = v + a, n + b
    few = few.where("shard >= 0")
    more = by_shard.cogroup(few.where(F.col("kind") == _PAIRS).groupBy("shard")).applyInArrow(_send_triples(buckets, least), MESSAGE_DDL)
    more = staged(more.groupBy("bucket").applyInArrow(_sum, ANSWER_DDL), "triples")
    found = by_shard.cogroup(few.union(more).groupBy("shard")).applyInArrow(_score(n, v, k, least), _OUT_DDL)
    return found.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, crc_mod(F.col("doc_id"), 5) != 1)
