"""SimHash, decontamination, packing and urls against brute force on small inputs."""

import random
import re
import zlib

import numpy as np
import xxhash
from cloakwork.llm import decontaminate, packing, simhash, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)], DOC)


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, apart=3):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= apart and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprint():
    rng = random.Random(1)
    for t in ["", " \t\n", "one", "A b", "É a\u00a0b c\x1cd e", "x " * 70_000, *(" ".join(rng.choices("ab cd ef GH é".split(), k=rng.randint(1, 60))) for _ in range(50))]:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


def test_components_by_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 200))) for _ in range(30)]
    texts = [None, "", "one", "one"]
    for b in base:
        for _ in range(rng.randint(1, 5)):
            w = b.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    got = {r[0]: (int(r[1]) & (1 << 64) - 1, r[2]) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == fps
    assert [got[i][1] for i in range(len(texts))] == plain_components(fps)


def test_links_of_large_cells(spark):
    """Cells over the bound go to finer grids, and no link is lost."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        fps.add(rng.choice(list(fps)) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 4))) & (1 << 64) - 1)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(100)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "_fp long")
    for most in (256, 8):
        root = {r[0]: r[1] for r in simhash.components(simhash.links(df, most=most)).collect()}
        got = [root.get(x, x) for x in signed]
        want = plain_components(fps)
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_simhash_edges(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    rows = simhash.near_duplicates(docs(spark, ["a b c", "a b c", "a b c"], [7, 7, None])).collect()
    assert sorted(str(r[0]) for r in rows) == ["7", "7", "None"] and {r[2] for r in rows} == {7}
    kept = simhash.keep_one(docs(spark, ["a b c", "a b c", "q r s t"], [7, 7, 8]))
    assert sorted(r[0] for r in kept.collect()) == [7, 8] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", "y", 3, 5, 6)], DOC + ", _fp long, cell long")
    assert simhash.near_duplicates(df).count() == 1
    assert sum(r.length for r in packing.pieces(df).collect()) == 5


def plain_hits(text, items, n=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        k = min(n, len(b))
        windows = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if k else set()
        for j in range(len(w) - k + 1):
            if k and tuple(w[j : j + k]) in windows:
                hit |= set(range(j, j + k))
                found.add(i)
    return len(w), len(hit), sorted(found)


def test_decontamination_by_brute_force(spark):
    rng = random.Random(4)
    def words(n):
        return [rng.choice("aa Bb cc dd éé 12 x,y".split()) for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([0, 1, 2, 5, 9, 10, 11, 14, 30])] + [(90, None), (91, "  "), (3, "aa bb cc")]
    items = [x for x in items if x[1] is None or len(x[1].split()) not in (1, 2)] + [(50, "unheard words")]
    texts = [None, "", "!", "AA bb; CC"] + [" ".join(words(rng.randint(0, 40)) + (items[rng.randrange(len(items))][1] or "").split() + words(5)) for _ in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 60):
        got = {r.doc_id: r for r in decontaminate.find_hits(docs(spark, texts), bench, max_bytes=most).collect()}
        for i, t in enumerate(texts):
            r = got[i]
            n, hit, found = plain_hits(t, items)
            assert (r.n_words, sum(b - a for a, b in zip(r.starts, r.ends)), list(r["items"])) == (n, hit, sorted(map(str, found)))


def test_decontamination_removes(spark):
    bench = spark.createDataFrame([(1, "the Quick brown fox jumps over the lazy dog today again")], "item_id long, text string")
    texts = ["clean text stays, as it is.", "start. The quick brown fox -- jumps over the lazy dog TODAY again! end", "the quick brown fox jumps over the lazy dog today again", None]
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert got[0].text == texts[0] and got[1].text == "start. ! end" and got[1].n_chars == 12 and 2 not in got and got[3].text is None
    assert [r.doc_id for r in decontaminate.decontaminate(docs(spark, texts), bench, "documents").orderBy("doc_id").collect()] == [0, 3]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs(spark, texts), none).count() == 4
    assert decontaminate.find_hits(docs(spark, []), bench).count() == 0


def test_decontamination_in_parts(spark):
    """Windows of one part overlap those of another; the parts of a benchmark change nothing."""
    w = [f"w{k}" for k in range(40)]
    items = [(i, " ".join(w[a : a + 13])) for i, a in enumerate((0, 7, 14, 25))] + [(9, " ".join(w[20:22] + w[38:] + ["x"] * 6))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(["start", *w[:20], "end"]), " ".join(["a", *w, "b"]), " ".join([*w[7:20], "z"]), " ".join(w[:27]), "clean"]
    want = ["start end", None, None, None, "clean"]
    for remove in ("spans", "documents"):
        got = [sorted(map(str, decontaminate.decontaminate(docs(spark, texts), bench, remove, max_bytes=most).collect())) for most in (10**6, 90, 20)]
        assert got[0] == got[1] == got[2]
    found = {r.doc_id: " ".join(r.text.split()) for r in decontaminate.decontaminate(docs(spark, texts), bench, max_bytes=20).collect()}
    assert found[0] == want[0] and found[4] == want[4] and found[1] == "a w38 w39 b" and 2 in found and found[2] == "z"


def test_packing_round_trip(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    texts = [None, "", "a<|endoftext|>b", "it's  é\u00a0ñ 漢字 😀 12345 ''s\r\n\t x" * 9, "word " * 9000, *(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect())]
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    rows = packing.pack(docs(spark, texts).repartition(3)).collect()
    got, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0 and r.start == len(got.get(r.doc_id, [])) and r.doc_tokens == len(want[r.doc_id])
        got.setdefault(r.doc_id, []).extend(ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    one = packing.pieces(docs(spark, texts[:3])).collect()
    assert {r.doc_id: r.ids_crc32 for r in one} == {i: zlib.crc32(np.array(want[i], "<u4").tobytes()) for i in range(3)}
    assert packing.pieces(docs(spark, [])).count() == 0


def test_costs_are_balanced():
    rng = random.Random(5)
    lengths = [rng.randint(1, 1500) for _ in range(3000)]
    cost = {}
    for _, _, n, s, _ in packing.arrange(lengths):
        cost.setdefault(s, [0, 0])
        cost[s][0] += n
        cost[s][1] += packing.cost(n)
    full = [c for n, c in cost.values() if n == 2048]
    assert max(full) / (sum(full) / len(full)) < 1.35


def test_urls(spark):
    cases = {
        "http://a.NET/x": ("a.net", "/x", "net/", "block"), "http://example.net/en/1?q#f": ("example.net", "/en/1", "example.net/en/", "allow"), "https://www.example.net/en": ("www.example.net", "/en", "net/", "block"),
        "x://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "x://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "x://b.org/fr/z": ("b.org", "/fr/z", "org/fr/", "allow"),
        "http://net": ("net", "", None, "allow"), "http://a.net?x=/": ("a.net", "", None, "allow"), "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://": ("", "", None, "allow"), "http://A.Net:80/é//": ("a.net:80", "/é//", None, "allow"), "http://..net//": ("..net", "//", "net/", "block"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(0, "http://a.NET/x")], "page_id long, url string")
    got = sorted(tuple(r) for r in urls.judge_urls(df).collect())
    assert [x[1:] for x in got[1:]] == list(cases.values()) and got[0] == got[1]
    one = spark.createDataFrame([(1, "http://a.b.c/path/more")], "page_id long, url string")
    assert urls.judge_urls(one, [("block", "b.c", "/pa"), ("allow", "c", "/path/mo")]).first().rule == "c/path/mo"
    assert urls.judge_urls(df.limit(0)).count() == 0


def plain_near_roots(texts, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_near_copies_lose_no_link(spark, monkeypatch):
    """A reordered text before its near copies, chains in one large cell, copies just above and below the bound, one passage in many texts."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for n in (80, 120, 200):  # the same words in another order come first
        base = rng.sample(words, n)
        texts.append(" ".join(sorted(base)))
        for _ in range(3):
            w = list(base)
            for _ in range(n // 60):
                k = rng.randrange(n - 1)
                w[k], w[k + 1] = w[k + 1], w[k]
            texts.append(" ".join(w))
    now = rng.sample(words, 150)
    for k in range(70):  # neighbours are similar, ends are not
        now[rng.randrange(150)] = f"v{k}"
        now[rng.randrange(150)] = f"u{k}"
        texts.append(" ".join(now))
    base = rng.sample(words, 100)
    for k in range(60):  # each about 0.8 from the base, less from each other
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(100)] = f"x{k}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    passage = rng.sample(words, 60)
    texts += [" ".join(rng.sample(words, 10) + passage + rng.sample(words, rng.randint(4, 10))) for _ in range(40)]
    texts += ["", " ", "one two", "One  two"]
    order = rng.sample(range(12, len(texts)), len(texts) - 12)
    texts = texts[:12] + [texts[k] for k in order]
    want = plain_near_roots([t.lower() for t in texts])
    for whole, part in ((2, 7), (simhash.WHOLE, simhash.PART)):
        monkeypatch.setattr(simhash, "PART", part)
        links = simhash.near_copies(docs(spark, texts), whole=whole)
        root = {r[0]: r[1] for r in simhash.components(links.distinct()).collect()}
        assert [root.get(k, k) for k in range(len(texts))] == want


def test_signatures_keep_near_sets():
    """No pair of sets at the bound or above is settled by its signature, whatever the sizes; most far ones are."""
    rng = np.random.default_rng(9)
    for n in (5, 8, 9, 10, 12, 16, 25, 50, 51, 80, 300):
        near, far = [], []
        for _ in range(300):
            common = int(np.ceil(0.8 * n))
            a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            b = np.concatenate([a[:common], rng.integers(0, 1 << 64, int(common / 0.8 - n + 1e-9), dtype=np.uint64)])
            near.append([(len(a), *simhash.signature(a)), (len(b), *simhash.signature(b))])
            c = np.concatenate([a[: n // 5], rng.integers(0, 1 << 64, n - n // 5, dtype=np.uint64)])
            far.append([(len(a), *simhash.signature(a)), (len(c), *simhash.signature(c))])
        near, far = np.array(near, dtype=np.int64), np.array(far, dtype=np.int64)
        assert simhash.may_be_near(near[:, 0], near[:, 1], 0.8).all()
        assert n < 25 or simhash.may_be_near(far[:, 0], far[:, 1], 0.8).mean() < 0.05


def test_hubs(spark, monkeypatch):
    """One node with most of the links, and chains."""
    from cloakwork.llm import graph

    links = [(k, 0) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(20)] + [(1010, 299), (5000, 4000)]
    df = spark.createDataFrame(links, "a long, b long")
    for hub in (10, 10**9):
        monkeypatch.setattr(graph, "HUB", hub)
        root = {r[0]: r[1] for r in graph.components(df).collect()}
        assert len(root) == 300 + 21 + 2 and {v for k, v in root.items() if k < 2000} == {0} and root[5000] == root[4000] == 4000


def test_names_of_items(spark):
    """Ids that are text or null; one item twice under two names."""
    text = "a b c d e f g h i j k"
    bench = spark.createDataFrame([("mmlu-1", text), (None, "one two three four five six seven eight nine ten"), ("x", text), (None, "never seen at all")], "item_id string, text string")
    df = docs(spark, [f"z {text} z", "one two three four five six seven eight nine ten", "nothing"])
    got = {r.doc_id: r for r in decontaminate.find_hits(df, bench).collect()}
    assert list(got[0]["items"]) == ["mmlu-1", "x"] and list(got[1]["items"]) == [None] and list(got[1].ends) == [10] and not got[2]["items"]
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(df, bench).collect()}
    assert left == {0: "z  z", 2: "nothing"}


def test_long_blanks_and_words(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    texts = [" " * 2_000_000, "a" + "\n" * 1_000_000 + "b", "x" * 300_000, "\u4e00" * 100_000]
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(texts)}
    got = {}
    for r in packing.pieces(docs(spark, texts)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want


def test_long_urls(spark):
    import time

    rows = [(1, "http://" + "a." * 50_000 + "net/" + "x/" * 50_000), (2, "http://example.net/en/" + "y/" * 100_000 + "?q"), (3, "no" * 100_000), (4, "x://" + "b" * 100_000)]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, _row string, rule string")
    urls.judge_urls(df.limit(1)).collect()
    start = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got == {1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: (None, "allow"), 4: (None, "allow")} and time.time() - start < 10
