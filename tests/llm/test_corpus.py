"""Substring dedup and LM scoring against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cloakwork.llm import exchange, lm, substrings
from pyspark.sql import functions as F

from .test_pairs import docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_removal(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        rest = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return out


def some_texts(rng, n=60):
    def words(k):
        return [rng.choice("abcdefgh") + rng.choice(["", "é", "1", "xyz"]) + str(rng.randint(0, 9)) for _ in range(k)]

    shared = [words(rng.choice([20, 34, 35, 36, 50, 120])) for _ in range(8)]
    texts = [None, "", " \t\n", "one", "a " * 34, "b " * 36, "c d " * 40]
    for _ in range(n):
        w = words(rng.randint(0, 60))
        for s in rng.sample(shared, rng.randint(0, 3)):
            a = rng.randint(0, 3)
            w += s[a : len(s) - rng.randint(0, 3)] + words(rng.randint(0, 20))
        texts.append(rng.choice([" ", "\n", "  \t"]).join(w))
    return texts + texts[-3:]


def test_word_hashes():
    rng = random.Random(1)
    texts = [(t or "").encode() for t in some_texts(rng)] + ["x y\x1cz q \x0b\x0c w".encode()]
    h, counts = exchange.word_hashes(texts)
    words = [w for t in texts for w in WORD.findall(t.decode())]
    assert counts.tolist() == [len(WORD.findall(t.decode())) for t in texts] and len(h) == len(words)
    by_word = {}
    assert all(by_word.setdefault(w, x) == x for w, x in zip(words, h.tolist())) and len(set(by_word.values())) == len(by_word)
    assert exchange.word_hashes([])[1].tolist() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_by_brute_force(spark, seed):
    texts = some_texts(random.Random(seed))
    rows = substrings.dedup_substrings(docs(spark, texts), shards=3).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == plain_removal(texts)
    assert rows[0].kept is None and rows[2].kept == texts[2]


def test_substrings_small_batches(monkeypatch):
    """Batches of a shard don't change what is found."""
    texts = [(t or "").encode() for t in some_texts(random.Random(3))]
    one = substrings._distinct([w.anchors for _, w in substrings._batches(texts, 35, 8)])
    monkeypatch.setattr(substrings, "BATCH_BYTES", 200)
    two = substrings._distinct([w.anchors for _, w in substrings._batches(texts, 35, 8)])
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1])


def test_substring_stage(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    texts = ["alpha\n beta", f"first part\n {shared} tail", f"{shared}", None, "", f"x {shared}"]
    got = {r.doc_id: r for r in substrings.remove_repeats(docs(spark, texts)).collect()}
    assert got[0].text == "alpha\n beta" and got[1].text == "first part tail" and got[1].n_chars == 15 and 2 not in got
    assert got[3].text is None and got[4].text == "" and got[5].text == "x" and got[0].source == "s"
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


def plain_scores(rows, k, least):
    def tokens(t):
        return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]

    learn = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(x for t in learn for x in t)
    pairs = Counter(p for t in learn for p in zip([0, *t], t))
    triples = Counter(p for t in learn for p in zip([0, *t], t, t[1:]))
    n, v, start = sum(c.values()), len(c), len(learn)
    out = []
    for i, t in rows:
        t = tokens(t)
        base = [(c[x] + 0.5) / (n + 0.5 * (v + 1)) for x in t]
        two = [(pairs[u, x] + k[0] * b) / ((start if u == 0 else c[u]) + k[0]) for u, x, b in zip([0, *t], t, base)]
        full = [p if u is None or pairs[u, w] < least else (triples[u, w, x] + k[1] * p) / (pairs[u, w] + k[1]) for u, w, x, p in zip([None, 0, *t], [0, *t], t, two)]
        out.append((i, zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(c[x] > 0 for x in t), n, sum(map(math.log10, base)), sum(map(math.log10, full))))
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_scores_by_brute_force(spark, least):
    rng = random.Random(4)
    texts = some_texts(rng) + ["A a A a b", "a a a a b"] + [" ".join(rng.choice("a b c dd".split()) for _ in range(n)) for n in (1, 2, 191, 192, 193, 194, 385, 2000)]
    got = lm.score_texts(docs(spark, texts), lm.crc_mod(F.col("doc_id"), 5) != 1, shards=3, least=least).orderBy("doc_id").collect()
    for r, want in zip(got, plain_scores(list(enumerate(texts)), lm.K, least), strict=True):
        assert tuple(r)[:5] == want[:5] and r.base_score == pytest.approx(want[5]) and r.score == pytest.approx(want[6])


def test_states_add_up():
    """From any state, probabilities of all known words and one unknown are 1; some arcs lead to states of pairs."""
    text = [1, 2, 1, 2, 3, 1, 2, 1, 1, 2, 3, 0]  # 4 is the start, 5 unknown
    before = [4, *text[:-1]]
    c, n, v = Counter(text), len(text), 4
    counts = np.array([c[w] for w in range(4)] + [1, 0])
    pairs = sorted(set(zip(before, text)))
    number = {p: i for i, p in enumerate(pairs)}
    pair_counts = np.array([Counter(zip(before, text))[p] for p in pairs])
    three = Counter(zip(before, text, text[1:]))
    triples = sorted(three)
    model = lm.Automaton(counts, np.array(pairs), pair_counts, np.array([(number[a, b], number[b, w]) for a, b, w in triples]), np.array([three[x] for x in triples]), n, v, (20.0, 5.0), 2)
    assert model.targets.max() > len(counts)
    for state in range(len(model.failure)):
        if state not in (1, 6):  # nothing follows the end or an unknown word
            after, weight = model.step(np.full(5, state), np.array([0, 1, 2, 3, 5]))
            assert (10**weight).sum() == pytest.approx(1.0)


def test_packed_keys():
    rng = np.random.default_rng(2)
    for keys in (rng.integers(0, 1 << 64, 5000, dtype=np.uint64), rng.integers(0, 300, 50, dtype=np.uint64), np.zeros(0, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)):
        keys = np.unique(keys)
        data = exchange.packed(keys)
        assert np.array_equal(exchange.unpacked(data), keys)
        for buckets in (1, 3, 100, 70_000):
            full, limits = exchange.by_bucket(keys, buckets)
            assert limits[-1] == len(keys) and [int(k) * buckets >> 64 for k in keys] == np.repeat(full, np.diff(limits)).tolist() or buckets > 1 << 16
    assert len(exchange.packed(np.unique(rng.integers(0, 1 << 64, 600_000, dtype=np.uint64)))) < 6.1 * 600_000


def test_held_out_beats_unigrams(spark, sf):
    rows = lm.op9_lm_scoring(spark, sf).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert lm.score_texts(docs(spark, []), F.lit(True)).count() == 0
    none = lm.score_texts(docs(spark, ["a b", None]), F.lit(False)).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in none)


def test_folder_where_none_is_named():
    from types import SimpleNamespace

    from cloakwork.llm import common

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="local[2]"))
    assert common.shared_dir(unset).startswith("file:///") and common.shared_dir(unset) == common.shared_dir(unset)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://x/y/"))
    assert common.shared_dir(named) == "hdfs://x/y"
    unset.sparkContext.master = "yarn"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(unset)
