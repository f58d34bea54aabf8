"""Page extraction on made pages; nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from cloakwork.llm import ann, pages

PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- x --><div class="ad">Buy now</div>'


def test_blocks():
    page = PAGE + '<article><header><h1>Head&amp;line</h1></header><p><b>One  two\n&nbsp;three.<br>four<p title="a>b">Five &lt;six&gt; &eacute;&#233;</p><div class="comments"><p>first!</p></div><form>f<input></form><p>1 < 2</p></article><footer>&copy; x</footer></body></html>'
    assert pages.main_texts([page]) == ["Head&line\n\nOne two three. four\n\nFive <six> éé\n\n1 < 2"]
    for cut in ("", "<", "text <b", "<!-- open", "<script>x", "&am", '<p class="'):
        pages.blocks(page[:300] + cut)
    assert pages.main_texts(["", "plain", "<p></p>"]) == ["", "plain", ""]


def test_host_repeats_go():
    def page(k):
        return f"<body><div>Welcome to our site dear guest</div><div>{' '.join(f'w{k}x{j}' for j in range(30))}</div><div>All rights reserved by us now</div></body>"

    assert pages.main_texts([page(k) for k in range(4)]) == [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(4)]
    assert len(pages.main_texts([page(1), page(1)])[0].split("\n\n")) == 3  # copies are one page; nothing else repeats
    art = "<body><article><p>Same text in two pages of one host</p></article><p>{}</p></body>"
    assert [x.split("\n\n")[0] for x in pages.main_texts([art.format("a b c d e"), art.format("f g h i j")])] == ["Same text in two pages of one host"] * 2


def test_repeated_by_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        streams = [np.array([rng.randint(0, 2) for _ in range(rng.randint(0, 12))], dtype=np.int64) for _ in range(4)]
        for run in (1, 2, 3, 4, 5):
            seen = {}
            for k, s in enumerate(streams):
                for i in range(len(s) - run + 1):
                    seen.setdefault(tuple(s[i : i + run]), set()).add(k)
            for s, got in zip(streams, pages.repeated(streams, run), strict=True):
                want = np.zeros(len(s), bool)
                for i in range(len(s) - run + 1):
                    if len(seen[tuple(s[i : i + run])]) > 1:
                        want[i : i + run] = True
                assert np.array_equal(got, want)


def test_suffix_array_by_sorting():
    rng = random.Random(4)
    for _ in range(40):
        streams = [[rng.randint(0, 2) for _ in range(rng.randint(0, 9))] for _ in range(3)]
        if not any(streams):
            continue
        array, shared = pages.suffixes([np.array(s, dtype=np.int64) for s in streams])
        every = [s[i:] for s in streams for i in range(len(s))]
        assert [every[i] for i in array] == sorted(every)
        for k in range(1, len(array)):
            x, y = every[array[k - 1]], every[array[k]]
            assert shared[k] == next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_marks():
    page = '<html class="has-footer"><body class="single no-sidebar"><article class="post related"><p>Hello…</p><section id="related-work"><p>Others did so</p></section><div class="share-price">12 euros</div><div class="comment-list"><p>first!</p></div><p>&am<b>p;</b></p></article></body>'
    assert pages.main_texts([page]) == ["Hello…\n\nOthers did so\n\n12 euros\n\n&amp;"]
    assert [pages.marked(f'<div class="{x}">') for x in ("ad", "site-nav", "x y", "breadcrumb-2", "ad-hoc", "mainMenu", "main")] == ["out", "out", "", "out", "doubt", "", "main"]


def test_the_array_decides():
    """What repeats on the host goes where markup leaves it open or in doubt; the same blocks stay without the array."""
    def page(k):
        own = " ".join(f"w{k}x{j}" for j in range(20))
        return f'<body><div>Welcome to our site dear guest</div><article><p>{own}</p><div class="share-price">Buy our stock at the market today</div><div class="related-work">paper {k} says that {k} is {k}</div><p>A paragraph that all of these pages quote</p></article></body>'

    for k, text in enumerate(pages.main_texts([page(k) for k in range(5)])):
        assert "Welcome" not in text and "stock" not in text and f"paper {k}" in text and "all of these pages quote" in text
    assert "Welcome" in pages.main_texts([page(1)])[0] and "stock" in pages.main_texts([page(1)], run=1000)[0]


def test_odd_pages(spark):
    """Very long html, columns with names that the operator uses, nulls."""
    long = "<article>" + "<p>word " * 200_000 + "<div " + "x" * 1_000_000
    rows = [(1, "http://a/1", long), (2, None, "<" * 100_000), (3, "http://a/2", "&" * 200_000), (None, "http://a/3", "<p>" + "a " * 500_000)]
    names = ["_host", "_group", "_part", "run", "text", "n_chars", "_id", "_html"]
    df = spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], "page_id long, url string, html string" + "".join(f", `{n}` string" for n in names))
    got = {r.page_id: r for r in pages.extract_pages(df).collect()}
    assert len(got) == 4 and got[1].text == "\n\n".join(["word"] * 200_000) and got[None].n_chars == 999_999 and got[3].text == "&" * 200_000


def test_extract_pages(spark, sf):
    df = spark.createDataFrame([(1, "http://a/x", PAGE + "<article><p>x</p></article>", 5), (1, "http://a/x", PAGE + "<article><p>x</p></article>", 5), (None, None, None, 5)], "page_id long, url string, html string, _host long")
    assert sorted(map(str, pages.extract_pages(df).collect())) == sorted(["Row(page_id=1, url='http://a/x', text='x', n_chars=1)"] * 2 + ["Row(page_id=None, url=None, text='', n_chars=0)"])
    assert pages.extract_pages(df.limit(0)).count() == 0
    few = pages.extract_pages(spark.read.parquet(f"{sf}/pages.parquet"), group_bytes=20_000).collect()
    assert len(few) == 50 and all(r.text and r.n_chars == len(r.text) for r in few)


def test_repeats_are_the_hosts(spark):
    """What two pages of a large host share goes however its pages are dealt."""
    rng = random.Random(6)

    def page(k):
        own = " ".join(f"w{k}x{j}" for j in range(30))
        pair = f"only two pages have notice {k // 2} of this kind"
        return f"<body><div>Welcome to our site dear guest</div><div>{own}</div><div>{pair}</div><article>Same article text everywhere here</article></body>"

    rows = [(k, f"http://hot/{k}", page(k)) for k in range(40)] + [(100 + k, f"http://cold{k}/", page(k)) for k in range(6)]
    rows += [rows[3], (None, "http://hot/x", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted(map(str, pages.extract_pages(df, group_bytes=b).collect())) for b in (10**6, 3000, 500)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 48
    assert not any("notice" in x or "Welcome" in x for x in got[0] if "http://hot/" in x)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain_nearest(rows, k=10):
    ok = {i: np.array(v, dtype=np.float32).astype(float) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % 100 == 0:
            out[q] = sorted((math.sqrt(((ok[q] - v) ** 2).sum()), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
    return out


def check(spark, rows, least):
    from pyspark.sql import functions as F

    got = {}
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.score, r.vec_id))
    want = plain_nearest(rows)
    assert set(got) == {q for q, x in want.items() if x}
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in got]
    for q in got:
        assert got[q] == sorted(got[q]) and len(got[q]) == len(want[q])
    assert sum(hits) / len(hits) >= least


def test_nearest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    check(spark, [tuple(r) for r in df.collect()], 0.95)


def test_nearest_recall_over_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(ann.build_index, "__defaults__", ("vec_id", "embedding", 300, *ann.build_index.__defaults__[3:]))
    check(spark, [(i, rng.normal(size=8).tolist(), 0) for i in range(1200)], 0.99)


def test_nearest_edges(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0) for i in range(60)] + [(100, same, 0), (100, same, 0), (200, [0.0, 0.0, 0.0], 0), (300, None, 0), (400, [1.0, None, 1.0], 0), (500, [float("nan"), 1.0, 1.0], 0), (600, [1.0, 2.0], 0), (None, same, 0), (700, [], 0), (800, [float("inf"), 0.0, 1.0], 0), (61, [1.0, 2.0, 4.0], 0)]
    check(spark, rows, 1.0)
    assert ann.nearest(vectors(spark, []), ann.F.col("vec_id") % 100 == 0).count() == 0
    assert [r.vec_id for r in ann.nearest(vectors(spark, rows), ann.F.col("vec_id") == 100).orderBy("rank").collect()] == list(range(10))


def test_query_blocks(spark, monkeypatch):
    """Queries in several blocks, ids with two vectors, columns with names used inside."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist(), 0, "z", "z", "z") for i in range(900)] + [(300, [9.0, 9.0, 9.0, 9.0], 0, "z", "z", "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, _id string, _v string, query_id string")
    one = ann.nearest(df, ann.F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ann, "BLOCK_BYTES", 200)
    assert ann.nearest(df, ann.F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect() == one
    assert len(one) == 90 and all(r.vec_id != r.query_id for r in one)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_small_graphs(n):
    v = np.random.default_rng(n).normal(size=(n, 4)).astype(np.float32)
    ids, _ = ann.Graph(v).search(v, 10)
    assert all(set(x[x >= 0]) == set(range(n)) for x in ids)
