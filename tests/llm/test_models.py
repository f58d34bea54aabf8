"""Language and quality models: exact inference, held-out accuracy, edge cases; the pipeline."""

import itertools
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from cloakwork.llm import decontaminate, langid, lm, packing, quality, simhash, substrings
from pyspark.sql import functions as F

from .test_corpus import plain_removal
from .test_pairs import DOC, docs, plain_components, plain_fingerprint, plain_hits


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_forward_backward_by_enumeration(block):
    rng = np.random.default_rng(block)
    lengths, k = np.array([1, 4, 7, 2]), 3
    e, t = rng.random((14, k)) + 0.1, rng.random((k, k)) + 0.1
    marginal, logs = langid.solve(e, t, lengths, block)
    at = 0
    for s, n in enumerate(lengths):
        total, want = 0.0, np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            p = t[:, path[0]].sum() / k * e[at, path[0]]
            for i in range(1, n):
                p *= t[path[i - 1], path[i]] * e[at + i, path[i]]
            total += p
            for i, x in enumerate(path):
                want[i, x] += p
        assert np.allclose(marginal[at : at + n], want / total) and np.isclose(logs[s], np.log(total))
        at += n


def test_languages(spark, sf):
    found = langid.op5_language_id(spark, "/root/testdata/sf0.01")
    df = found.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (df.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in df.doc_id]).all()
    assert (df.lang == df.lang_pred)[df.held_out].mean() > 0.97 and df.score.between(0, 1).all()


def test_code_switching():
    rng = np.random.default_rng(1)
    one, two = [f"aba{x}" for x in "bcdfg"], [f"zoz{x}" for x in "bcdfg"]
    model = langid.fit([("a", " ".join(rng.choice(one, 60))) for _ in range(30)] + [("z", " ".join(rng.choice(two, 60))) for _ in range(30)], steps=30)
    marginal, lettered, n = langid.mark_words([" ".join([*one, "12", *two])], model)
    assert [model.labels[k] for k in marginal.argmax(1)] == ["a"] * 5 + [model.labels[marginal[5].argmax()]] + ["z"] * 5 and not lettered[5] and n.tolist() == [11]


def test_language_edges(spark):
    texts = [None, "", "12 !! 3", "aaa bbb aaa", "zz yy zz", "aaa bbb", "x" * 100_000, "é " * 5000]
    rows = [(i, t, "la" if i in (3, 5) else None if i == 7 else "lz", "s", 0) for i, t in enumerate(texts)] * 2 + [(None, "aaa", "la", "s", 0)]
    got = langid.identify(spark.createDataFrame(rows, DOC), F.lit(True)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 17 and [by_id[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and by_id[0].score == 0
    assert by_id[5].lang_pred == "la" and by_id[4].lang_pred == "lz" and not by_id[4].held_out
    assert {r.lang_pred for r in langid.identify(docs(spark, ["aa bb", None]), F.lit(False)).collect()} == {"und"}
    assert langid.identify(docs(spark, []), F.lit(True)).count() == 0


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    df = quality.op8_quality_classifier(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    bad = (df.quality_y == 0) | (df.toxic == 1)
    assert (~df.keep)[bad].mean() > 0.93 and df.keep[~bad].mean() > 0.98


def test_quality_edges(spark):
    texts = [None, "", "x", "a b " * 30_000]
    no = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs(spark, texts), no).collect()
    assert len(got) == 4 and all(r._low == 0 and r._toxic == 0 for r in got)
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (None, 0, 0), (2, 1, 0), (2, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = spark.createDataFrame([(1, "x y", None, None, None, 3)] * 2 + [(2, "a", "en", "s", 1, 3)], DOC + ", _low int")
    got = quality.score(rows, labels).collect()
    assert len(got) == 3 and all(r._low == 0 and r._toxic == 1 for r in got)
    assert quality.score(docs(spark, []), labels).count() == 0


def test_co_training_exchanges():
    """A view that knows little learns from what the other one is sure of."""
    rng = np.random.default_rng(3)
    n = 900
    y = (np.arange(n) % 3 == 0).astype(float)
    labelled = np.arange(n) < 300
    texts = [sorted({7 if y[i] else 8, 100 + int(rng.integers(50))}) for i in range(n)]
    metas = [[int(y[i]) if rng.random() < 0.97 else int(rng.integers(2))] for i in range(n)]
    t = quality.Target(y, labelled, quality.flat(texts), np.zeros((n, 2)), quality.flat(metas), 2, 0.9, 100)
    place = {f: k for k, f in enumerate(t.columns.tolist())}
    p = t.probability([np.array([place[f] for f in x if f in place], dtype=int) for x in texts], np.zeros((n, 2)), quality.flat(metas))
    assert ((p > 0.5) == (y == 1)).mean() > 0.99
    assert len(t.exchanged) == 2 and min(min(x) for x in t.exchanged[0]) > 0 and t.curve[0] > 0 and t.curve[1] > 0


def test_co_training_on_labels(spark):
    """For low quality both views get labels from each other and count; in these tables metadata says nothing of toxic, so it need not."""
    sf = "/root/testdata/sf0.1"
    docs_now, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 5 = 0")
    targets = quality.train(docs_now, labels.where("doc_id % 5 <> 0"))
    for name, t in targets.items():
        print(name, "exchanged:", t.exchanged, "weights:", t.curve)
        assert sum(t.exchanged[0][0]) > 0 and t.curve[0] > 0
        assert name == "toxic" or sum(t.exchanged[0][1]) > 0 and t.curve[1] > 0
    df = docs_now.join(held.select("doc_id"), "doc_id", "left_semi").toPandas().merge(held.toPandas(), on="doc_id")
    for name, y in (("low", (df.quality == 0).to_numpy()), ("toxic", (df.toxic == 1).to_numpy())):
        t = targets[name]
        place = {f: k for k, f in enumerate(t.columns.tolist())}
        words = [[place[f] for f in {x for w in set(text.lower().split()) for x in quality.stems(w)} if f in place] for text in df.text]
        shapes = np.array([quality.shape(x, x.split()) for x in df.text])
        metas = quality.flat([quality.metadata(a, b, len(c)) for a, b, c in zip(df.lang, df.source, df.text)])
        both = t.probability([np.array(x, dtype=int) for x in words], shapes, metas)
        text = np.array([t.text.w[x].sum() for x in words]) + t.text.b
        right = ((both >= 0.5) == y).mean()
        assert right >= ((text >= 0) == y).mean() and right > 0.98


def test_quality_sample_is_bounded(spark):
    """Null ids and repeated ids don't widen the sample, and it has as many rows as asked for."""
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(300)] + [(7, "other", "en", "s", 5)] * 200 + [(None, "none", "en", "s", 4)] * 200
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = quality.sample(spark.createDataFrame(rows, DOC), labels, 40, 30).collect()
    assert len(got) == len({r[0] for r in got}) == 70 and sum(r.low is None for r in got) == 30 and all((r[0] % 2 == 0) == (r.low is not None) for r in got)


NAMES = "_id _text _rest _fp _stay _shard cell root label node a b count n_words kept text2 _low _toxic bucket shard kind".split()


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, more columns with names that operators use inside."""
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "a b", "en", None, 3), (3, "a b", "en", None, 3), (4, "word " * 60_000, "en", "s", None), (None, "some text here", "en", "s", 14), (5, "\u00e9\u4e2d \U0001f600 !!", "fr", "s", 8)]
    schema = DOC + "".join(f", `{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], schema)


def test_stages_and_operators_on_odd_documents(spark, sf):
    odd = odd_documents(spark)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs_now in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs_now, sf)
            assert name == "packing" or out.columns == columns
            rows = out.collect()
            assert bool(rows) == (docs_now is odd)
            if name == "simhash near-dedup" and docs_now is odd:
                assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "4", "5", "None", "None"]
        n = docs_now.count()
        assert simhash.near_duplicates(docs_now).count() == n
        assert decontaminate.find_hits(docs_now, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == n
        assert substrings.dedup_substrings(docs_now).count() == n
        assert langid.identify(docs_now, F.col("doc_id") > 0).count() == n
        assert lm.score_texts(docs_now, F.col("doc_id") > 0).count() == n
        assert quality.score(docs_now, spark.read.parquet(f"{sf}/labels.parquet")).count() == n


def plain_kept(before, least=0.8):
    """Ids that stay: the least of each group that fingerprints or five-word shingles link."""
    sets = []
    for r in before:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = plain_components([plain_fingerprint(r.text) for r in before])
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {before[k].doc_id for k in range(len(before)) if root[k] == k}


def test_near_copies(spark):
    """Copies with a few words changed, one group of many, and documents that only share words."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for n in (60, 100, 300, 1000):
        base = rng.choice(vocabulary, n).tolist()
        for _ in range(40 if n == 300 else 4):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, n // 60)))):
                w[int(rng.integers(n))] = "other"
            texts.append(" ".join(w))
        texts.append(" ".join(sorted(base)))
    texts += [" ".join(rng.choice(vocabulary, 80)) for _ in range(60)] + ["", None, "one two"]
    df = docs(spark, texts)
    got = {r.doc_id for r in simhash.keep_one(df).collect()}
    want = plain_kept(df.orderBy("doc_id").collect())
    assert len(got ^ want) <= 1 and 64 <= len(want) <= 80


def test_pipeline_by_brute_force(spark, sf):
    """Each stage after the classifier against a plain version of it on its own input."""
    docs_now = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs_now.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs_now.orderBy("doc_id").collect()
        after = corpus_pipeline.staged(stage(spark, docs_now, sf), "test")
        rows = {r.doc_id: r for r in after.collect()}
        if name != "packing":
            assert after.columns == columns
        if name == "quality classifier":
            assert 0.5 < len(rows) / len(before) < 1 and all(rows[r.doc_id] == r for r in before if r.doc_id in rows)
        elif name == "simhash near-dedup":
            assert set(rows) == plain_kept(before)
        elif name == "substring dedup":
            for r, (n, gone, digest) in zip(before, plain_removal([r.text for r in before]), strict=True):
                assert (r.doc_id in rows) == (gone == 0 or gone < n)
                if r.doc_id in rows:
                    assert rows[r.doc_id].text == r.text if gone == 0 else substrings.hashlib.sha256(rows[r.doc_id].text.encode()).hexdigest() == digest
        elif name == "benchmark decontamination":
            for r in before:
                n, hit, _ = plain_hits(r.text, bench)
                assert (r.doc_id in rows) == (hit == 0 or hit < n)
                if r.doc_id in rows:
                    assert rows[r.doc_id].text == r.text if hit == 0 else len(decontaminate.fold_words(rows[r.doc_id].text.encode())) == n - hit
        else:
            encode = packing.encoder(packing.tokenizer_file())
            got = {}
            for r in sorted(after.collect(), key=lambda r: (r.doc_id, r.start)):
                got.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
            assert got == {r.doc_id: [*encode(r.text), 1] for r in before}
        docs_now = after
    assert simhash.MAX_BITS == 3


def test_language_of_text_without_blanks():
    """Texts that differ only beyond the first and last 20 characters: each is one word."""
    rng = random.Random(8)

    def text(letters, n):
        return "m" * 20 + "".join(rng.choice(letters) for _ in range(n)) + "m" * 20

    sides = {"aa": "\u4e00\u4e8c\u4e09\u56db", "bb": "\u3042\u3044\u3046\u3048"}
    model = langid.fit([(lang, text(x, 60)) for lang, x in sides.items() for _ in range(20)])
    for lang, x in sides.items():
        for n in (60, 5000):
            marginal, lettered, lengths = langid.mark_words([text(x, n)], model)
            assert lengths.tolist() == [1] and lettered.all() and marginal[0, model.labels.index(lang)] > 0.9


def test_language_sample_is_bounded(spark):
    """Ids that are null or repeat don't widen the sample; every language is there."""
    rows = [(None, f"null {k}", "aa", "s", 1) for k in range(500)] + [(7, f"seven {k}", "bb", "s", 1) for k in range(300)] + [(k, "x y", f"l{k}", "s", 1) for k in range(600)]
    got = langid.sample(spark.createDataFrame(rows, DOC), F.lit(True), "doc_id", "text", "lang", 20)
    by = {lang: sum(x == lang for x, _ in got) for lang, _ in got}
    assert len(by) == 602 and by["aa"] == by["bb"] == 20 and by["l599"] == 1
