"""Detection, span algebra and rewriting against a plain model, fixtures and properties."""

import os
import random
import re
import subprocess
import sys

from cloakwork.functions import rewrite, rules, spans, sql
from cloakwork.plans import queries
from pyspark import cloudpickle
from pyspark.sql import functions as F

from . import model


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    rows = df.withColumn("s", spans.detect(F.col("text"))).select("i", "s", rewrite.redact(F.col("text"), F.col("s")).alias("r"), rewrite.mask(F.col("text"), F.col("s")).alias("m")).orderBy("i").collect()
    return [([tuple(x)[:4] for x in r.s], r.r, r.m) for r in rows]


def test_edges(spark):
    got = found(spark, [*model.EDGES, None, "", " \n\t "])
    assert [g[0] for g in got] == [*model.EDGES.values(), [], [], []]
    assert {t: model.detect(t) for t in model.EDGES} == model.EDGES
    assert got[-3][1] is None and got[-1][1] == " \n\t "
    at = list(model.EDGES).index("email: @x")
    assert got[at][2] == "email: @*"


def test_golden(spark):
    s, redacted, masked = found(spark, [model.GOLDEN])[0]
    assert [x[0] for x in s] == ["PERSON", "DATE_OF_BIRTH", "IN_PHONE", "EMAIL_ADDRESS", "LOCATION", "IN_PAN", "IN_AADHAAR", "IN_PASSPORT", "BANK_NAME", "BANK_ACCOUNT", "IFSC_CODE", "UPI_ID", "IP_ADDRESS", "DEVICE_ID", "HASH_VALUE"]
    assert [line.split(": ", 1)[1] for line in masked.split("\n")[:-1]] == model.GOLDEN_MASKS
    assert redacted.count("[REDACTED]") == 15


WORDS = ["Name:", "name =", "customer", "Mr.", "Asha", "Rao", "DOB:", "5 May 1990", "01/02/1999", "2024-01-31", "9000000001", "+91", "1111 2222 3333", "ABCDE1234F", "Z1234567", "10.1.2.3", "a.b@c.org", "x@okaxisupi", "@", "account holder:", "Account no:", "IFSC", ":", "=", "DEMO0000001", "android-0123456789", "fp_hash_0123456789ab", "4111-1111 1111 1111", "é", "😀", " ", "\n", "\t", "user", "items Foo", "address:", "City:", "pin code:", "PAN card:", "0" * 32, "deadbeef" * 8, "bank:", "x", "-", "ſpouse Abc", "Device id = 12", "credit card #:", "e-mail:"]


def test_random_texts_against_the_model(spark):
    rng = random.Random(7)
    texts = [rng.choice([" ", " ", ""]).join(rng.choice(WORDS) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    for t, (s, redacted, _) in zip(texts, found(spark, texts), strict=True):
        assert s == model.detect(t), t
        assert all(a[2] <= b[1] for a, b in zip(s, s[1:]))
        rest = t
        for _, a, b, _ in reversed(s):
            rest = rest[:a] + "[REDACTED]" + rest[b:]
        assert rest == redacted


def test_documents_against_the_model(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    for (t,), (s, _, _) in zip(rows, found(spark, [r[0] for r in rows]), strict=True):
        assert s == model.detect(t)


def test_cells_and_batches_agree(spark):
    """Cell by cell or joined by the separator: the same spans."""
    rng = random.Random(8)
    for _ in range(300):
        cells = ["".join(rng.choice(WORDS) + rng.choice(["", " "]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))]
        cells = [c for c in cells if c.strip()]
        joined = "\n\x00\n".join(cells)
        at, want = 0, []
        for c in cells:
            want += [(e, a + at, b + at, s) for e, a, b, s in model.detect(c)]
            at += len(c) + 3
        assert model.detect(joined) == want


def test_resolve_fixtures(spark):
    cases = [
        ([("PERSON", 0, 5, 0.85), ("LOCATION", 3, 9, 0.85)], [1]), ([("PERSON", 0, 10, 0.85), ("IN_PAN", 8, 15, 0.9)], [0]), ([("IN_PHONE", 0, 10, 0.85), ("BANK_ACCOUNT", 0, 10, 0.4)], [1]),
        ([("BANK_ACCOUNT", 0, 14, 0.4), ("CREDIT_CARD", 0, 14, 0.5)], [1]), ([("PERSON", 0, 5, 0.85), ("PERSON", 5, 9, 0.85)], [0, 1]), ([("PERSON", 0, 5, 0.85), ("PERSON", 2, 7, 0.85)], [0]), ([], []), ([("NEW", 0, 3, 0.5), ("NAME", 0, 3, 0.9)], [0]),
    ]
    rng = random.Random(9)
    kinds = ["PERSON", "IN_PAN", "NAME", "NEW", "BANK_ACCOUNT"]
    made = [[(rng.choice(kinds), a := rng.randint(0, 20), a + rng.randint(1, 8), rng.choice([0.4, 0.5, 0.9])) for _ in range(rng.randint(0, 8))] for _ in range(800)]
    rows = [[(e, a, b, s, k, rules.TIER_OF.get(e, 1)) for k, (e, a, b, s) in enumerate(x)] for x in [c[0] for c in cases] + made]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"i int, s {spans.SPANS}").select("i", spans.resolve(F.col("s")).alias("s")).orderBy("i").collect()
    got = [[tuple(x)[:4] for x in r.s] for r in got]
    assert got[: len(cases)] == [[c[0][k] for k in c[1]] for c in cases]
    assert got[len(cases) :] == [model.folded(x) for x in made]


def test_small_span_operators(spark):
    text = "Asha Rao DOB:\n  Foo, bar"
    s = [("PERSON", 0, 13, 0.9, 0, 2), ("PERSON", 8, 13, 0.9, 1, 2), ("LOCATION", 9, 20, 0.9, 2, 2), ("NAME", 13, 19, 0.9, 3, 0)]
    df = spark.createDataFrame([(text, s)], f"text string, s {spans.SPANS}")
    t, c = F.col("text"), F.col("s")
    row = df.select(spans.clip_at_newline(c, t).alias("a"), spans.trim_trailing_labels(c, t).alias("b"), spans.trim_leading_space(c, t).alias("c"), spans.shift(c, F.lit(5)).alias("d"), spans.window_dedup(c).alias("e"), spans.merge_adjacent(c).alias("f")).first()
    cut = lambda x: [tuple(y)[:3] for y in x]
    assert cut(row.a) == [("PERSON", 0, 13), ("PERSON", 8, 13), ("LOCATION", 9, 13)]
    assert cut(row.b) == [("PERSON", 0, 8), ("LOCATION", 9, 20), ("NAME", 13, 19)]
    assert cut(row.c)[3] == ("NAME", 16, 19) and cut(row.d)[0] == ("PERSON", 5, 18)
    assert cut(row.e) == [("PERSON", 0, 13), ("NAME", 13, 19)]
    assert cut(row.f) == [("PERSON", 0, 13), ("LOCATION", 9, 20), ("NAME", 13, 19)]


def test_masks(spark):
    cases = [
        ("EMAIL_ADDRESS", "@x", "@*"), ("EMAIL_ADDRESS", "a@b@c", "a****"), ("EMAIL_ADDRESS", "ab@c.d", "a*@c.d"), ("IN_PHONE", "12", "1*"), ("IN_PHONE", "+91 12", "9112"), ("IN_AADHAAR", "abc", "XXXX XXXX XXXX"),
        ("IN_PAN", "ABCDE", "A****"), ("PERSON", "A", "A"), ("IP_ADDRESS", "x", "x.***.***.***"), ("BANK_ACCOUNT", "123", "1**"), ("CREDIT_CARD", "12-3", "1***"), ("UPI_ID", "@abc", "@***"), ("UPI_ID", "ab@c", "a*@c"), ("IN_PASSPORT", "Z", "[REDACTED]"), ("LOCATION", "x", "[REDACTED]"), ("NEW", "x", "[REDACTED]"), ("NEW", "xyz", "x**"), ("DATE_OF_BIRTH", "x", "** **** 19**"), ("PHONE_NUMBER", "123456", "12**56"), ("NAME", "Ünal", "Ü***"),
    ]
    got = spark.createDataFrame(cases, "e string, v string, w string").withColumn("m", rewrite.mask_value(F.col("v"), F.col("e"))).collect()
    assert [r.m for r in got] == [c[2] for c in cases]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "a@b.co and c@d.co, 10.1.2.3"), (2, "a@b.co")], "i int, t string").withColumn("s", spans.detect(F.col("t")))
    a, b = [r[0] for r in df.orderBy("i").select(rewrite.tokenize(F.col("t"), F.col("s"), F.col("i"))).collect()]
    first, rest = a.split(" and ")
    assert rest.startswith(first + ", <") and first != b and len(first) == 38
    c = df.orderBy("i").select(rewrite.tokenize_random(F.col("t"), F.col("s"))).first()[0]
    assert c.split(" and ")[1].startswith(c.split(" and ")[0])
    none = df.select(rewrite.sanitize(F.col("t"), F.col("s"), "other").alias("x")).first().x
    assert none.n == 0 and "@" in none.text


def test_table_function_over_all_cores(spark, sf):
    """A small file of keys, of which each gives a long text, is not scanned by one task."""
    df = queries.detect_udtf(spark, sf)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df.count() == 27 * spark.read.parquet(f"{sf}/customer.parquet").count()


def test_table_function_tries_patterns_where_they_can_begin(spark, sf):
    """The scan of the table function finds what each rule finds alone."""
    rng = random.Random(10)
    more = ["x+919000000001", "face_tmp_01234567", "0123ABCD-0000-4000-8000-0123456789AB", "٣٤٥٦٧٨٩٠١٢٣٤", "İmei: 12", "ıfsc: ab", "K", "ΣΑΣ", "_", ".", "+", "é.a@okupi", "9" * 20, "1 " * 14, "1.2.3.4.5.6.7.8", "2024-01-012024-02-02", "ip:"]
    texts = [rng.choice([" ", " ", "", "\n"]).join(rng.choice(WORDS + more) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    texts += ["".join(rng.choice("aAfFxX09 +.-@_%:=\n\t#'é٣ſİ") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    scan = sql.Scan()
    for t in texts:
        assert sql.plain_spans(t, scan) == model.detect(t), t
        alone = [(k, *m.span()) for k, r in enumerate(rules.PATTERN_RULES) for m in re.finditer(r.regex, t)]
        assert sorted(scan.patterns(t)) == alone, t


def test_table_function_goes_to_workers_whole(tmp_path):
    """Executors have no copy of the package."""
    (tmp_path / "handler").write_bytes(cloudpickle.dumps(sql._DetectSpans))
    run = "from pyspark import cloudpickle; print(list(cloudpickle.load(open('handler', 'rb'))().eval('Mr. Asha Rao')))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout == "[('PERSON', 4, 12, 0.85)]\n"


def test_rules_that_begin_with_a_class():
    known = {r.name: re.compile(r.regex) for r in rules.PATTERN_RULES}
    for _, _, names in sql._FIRST:
        assert all(known[n].groups == 0 and known[n].pattern.startswith(r"\b") for n in names)
    assert {r.name for r in rules.PATTERN_RULES if "@" in r.needs} == set(sql._ON_LINES)
