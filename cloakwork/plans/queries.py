"""The registered queries: name -> (Spark, DuckDB's SQL or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rewrite, rules, spans, threats
from ..operators import catalog as cat
from ..operators import detection, geometry, screening
from ..sources import files as filing
from . import oracle, views
from .views import TEXTS, table, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
SALT = "pepper"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = (f, sql)
        return f

    return keep


def _span_rows(df: DataFrame, column: str = "spans") -> DataFrame:
    rows = detection.span_table(df, "doc_id", column)
    return rows.select("doc_id", "entity_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "score")


_ROWS = "SELECT doc_id, typ AS entity_type, s AS span_start, e AS span_end, score FROM"


def _one_rule(rule: rules.Rule, order: int, label: bool) -> None:
    scan, sql = (spans.keyword_spans, oracle.label_spans) if label else (spans.match_spans, oracle.rule_spans)

    @query(f"rule_{rule.name}", f"WITH texts AS ({TEXTS}) {_ROWS} ({sql(rule, order)})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _span_rows(detection.spread(texts(spark, sf_dir)).select("doc_id", detection.pinned(scan(F.col("text"), rule, order)).alias("spans")))


for _k, _rule in enumerate(rules.PATTERN_RULES):
    _one_rule(_rule, _k, False)
_LABELS = rules.keyword_rules()
_LABEL_ORDERS = {r.name: 100 + k for k, r in enumerate(_LABELS)}
for _rule in _LABELS:
    _one_rule(_rule, _LABEL_ORDERS[_rule.name], True)


@query("kw_all", f"WITH texts AS ({TEXTS}) {_ROWS} ({' UNION ALL '.join(oracle.label_spans(r, _LABEL_ORDERS[r.name]) for r in _LABELS)})")
def kw_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detection.spread(texts(spark, sf_dir)).withColumn("_fold", spans.folded(F.col("text")))
    return _span_rows(df.select("doc_id", detection.pinned(spans.keyword_scan(F.col("text"), fold=F.col("_fold"))).alias("spans")))


# A made span table: several spans a document, of several types, that overlap and cross line breaks.
_LOOSE = "SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE l_partkey % 6 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'IN_PAN' WHEN 2 THEN 'NAME' WHEN 3 THEN 'BANK_ACCOUNT' WHEN 4 THEN 'NEW' ELSE 'IN_PHONE' END AS typ, l_suppkey % 20 AS s, l_suppkey % 20 + 1 + l_partkey % 9 AS e, CASE l_suppkey % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.5 ELSE 0.9 END AS score FROM " + views.ITEMS
_BROKEN = "'Asha Rao DOB:' || chr(10) || '   Foo' || chr(10) || 'Bar Mobile and 12345'"


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.from_lines(spark, sf_dir, _LOOSE).withColumn("score", F.col("score").cast("double"))
    one = spans.span(F.col("typ"), F.col("s"), F.col("e"), F.col("score"), F.col("ord"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", one.alias("x"))))
    return df.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["x"]).alias("spans")).withColumn("text", F.expr(_BROKEN))


_LOOSE_SQL = f"WITH loose AS (SELECT doc_id, ord, typ, s, e, score::DOUBLE AS score FROM ({_LOOSE})), texts AS (SELECT DISTINCT doc_id, {_BROKEN} AS text FROM loose)"


@query("spans_resolve", f"{_LOOSE_SQL} {_ROWS} ({oracle.folded('loose')})")
def spans_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(_loose(spark, sf_dir).withColumn("spans", spans.resolve(F.col("spans"))))


@query("spans_clip_newline", f"{_LOOSE_SQL} {_ROWS} ({oracle.clipped('loose')})")
def spans_clip_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(_loose(spark, sf_dir).withColumn("spans", spans.clip_at_newline(F.col("spans"), F.col("text"))))


_TRIM = f"SELECT doc_id, typ, s, score, CASE WHEN typ IN ('PERSON', 'NAME') THEN s + length(regexp_split_to_array(substr(text, s + 1, e - s), {oracle.quoted('(?i)' + rules.TRAILING_LABEL[:-1] + r'\n?$')})[1]) ELSE e END AS e FROM loose JOIN texts USING (doc_id)"


@query("spans_trim_labels", f"{_LOOSE_SQL} {_ROWS} ({_TRIM}) WHERE e > s")
def spans_trim_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(_loose(spark, sf_dir).withColumn("spans", spans.trim_trailing_labels(F.col("spans"), F.col("text"))))


_LAST = "m[len(m)]"
_WINDOW_FOLD = f"list_reduce(list_transform(l, lambda x: [x]), lambda m, r: CASE WHEN r[1].s >= {_LAST}.e THEN list_concat(m, r) WHEN r[1].e - r[1].s > {_LAST}.e - {_LAST}.s THEN list_concat(m[1:len(m) - 1], r) ELSE m END)"


@query("window_dedup", f"{_LOOSE_SQL} SELECT doc_id, x.s AS span_start, x.e AS span_end FROM (SELECT doc_id, unnest({_WINDOW_FOLD}) AS x FROM (SELECT doc_id, list_sort(list({{'s': s, 'n': s - e, 'e': e}})) AS l FROM loose GROUP BY doc_id))")
def window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(_loose(spark, sf_dir).withColumn("spans", spans.window_dedup(F.col("spans")))).select("doc_id", "span_start", "span_end")


@query("tier_lookup", f"{_LOOSE_SQL} SELECT typ AS entity_type, ({oracle.tier()})::BIGINT AS tier, count(*) AS n FROM loose GROUP BY ALL")
def tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.from_lines(spark, sf_dir, _LOOSE)
    return df.groupBy(F.col("typ").alias("entity_type")).agg(F.max(spans.tier(F.col("typ"))).cast("long").alias("tier"), F.count("*").alias("n"))


@query("detect_fast", f"{oracle.detected()} {_ROWS} spans")
def detect_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(detection.with_spans(detection.spread(texts(spark, sf_dir))))


# The short path clips patterns only, and has no model here.
_SHORT = f"short AS (SELECT * FROM texts WHERE length(text) <= {spans.FAST_PATH_CHARS}), long AS (SELECT * FROM texts WHERE length(text) > {spans.FAST_PATH_CHARS})"
_ROUTED = f"""WITH texts AS ({TEXTS}), {_SHORT}, cand AS ({oracle.all_rules()}),
  clip AS ({oracle.clipped('cand')}),
  mixed AS (SELECT * FROM clip WHERE doc_id IN (SELECT doc_id FROM long) OR ord < 100 UNION ALL SELECT * FROM cand WHERE ord >= 100 AND doc_id IN (SELECT doc_id FROM short)),
  spans AS ({oracle.folded('mixed')})"""


@query("detect_routed", f"{_ROUTED} {_ROWS} spans")
def detect_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(detection.with_routed_spans(detection.spread(texts(spark, sf_dir))))


def _clean(df: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    return detection.sanitize(detection.spread(df), mode, "text", key, SALT).select("doc_id", "clean", F.col("n_spans").cast("long").alias("n_spans"))


_DOCS = "SELECT doc_id, text FROM documents"


@query("redact_documents", oracle.rewritten("'[REDACTED]'", _DOCS))
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(table(spark, sf_dir, "documents").select("doc_id", "text"), "redact")


@query("redact_corpus", oracle.rewritten("'[REDACTED]'", views.RECORDS))
def redact_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(views.records(spark, sf_dir), "redact")


@query("mask_documents", oracle.rewritten(oracle.mask("orig", "typ"), _DOCS))
def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(table(spark, sf_dir, "documents").select("doc_id", "text"), "mask")


@query("mask_corpus", oracle.rewritten(oracle.mask("orig", "typ"), views.RECORDS))
def mask_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(views.records(spark, sf_dir), "mask")


@query("tokenize_keyed", oracle.rewritten(oracle.token("typ", "doc_id::VARCHAR", SALT), views.RECORDS))
def tokenize_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(views.records(spark, sf_dir), "tokenize", "doc_id")


@query("tokenize_uuid")
def tokenize_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(views.records(spark, sf_dir), "tokenize")


@query("sanitize_unknown_mode", f"SELECT c_custkey AS doc_id, {views.RECORD} AS clean, 0::BIGINT AS n_spans FROM customer")
def sanitize_unknown_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(views.records(spark, sf_dir), "other")


_VALUES = "SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN 'a' || c_custkey || '@x.org' WHEN 1 THEN '+91 98' || c_custkey WHEN 2 THEN c_name WHEN 3 THEN CAST(c_custkey % 10 AS STRING) WHEN 4 THEN '10.2.' || c_custkey ELSE '@' || c_custkey || '-22' END AS v FROM customer"


def _one_mask(entity: str) -> None:
    @query(f"mask_{entity.lower()}", f"SELECT doc_id, {oracle.mask('v', oracle.quoted(entity))} AS masked FROM ({_VALUES})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.sql(_VALUES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
        return df.select("doc_id", rewrite.mask_value(F.col("v"), F.lit(entity)).alias("masked"))


for _entity in [*rules.TIERS[3], *rules.TIERS[2], "NAME", "USERNAME"]:
    _one_mask(_entity)


# What is found, counted.


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detection.with_spans(detection.spread(texts(spark, sf_dir)))
    return df.select("doc_id", "lang", F.length("text").alias("chars"), "spans")


@query("entity_profile", f"{oracle.detected()} SELECT typ AS entity_type, count(*) AS n, count(DISTINCT doc_id) AS docs, sum(e - s)::BIGINT AS chars FROM spans GROUP BY typ")
def entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _found(spark, sf_dir).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    return rows.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query("entity_by_lang", f"{oracle.detected()} SELECT lang, typ AS entity_type, count(*) AS n FROM spans JOIN texts USING (doc_id) GROUP BY ALL")
def entity_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("lang", F.explode("spans.entity_type").alias("entity_type")).groupBy("lang", "entity_type").agg(F.count("*").alias("n"))


@query("entity_cube", f"{oracle.detected()} SELECT lang, typ AS entity_type, count(*) AS n FROM spans JOIN texts USING (doc_id) GROUP BY CUBE (lang, typ)")
def entity_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("lang", F.explode("spans.entity_type").alias("entity_type")).cube("lang", "entity_type").agg(F.count("*").alias("n"))


@query("pii_density", f"{oracle.detected()}, c AS (SELECT doc_id, count(*) AS n, sum(e - s) AS chars FROM spans GROUP BY doc_id) SELECT doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(chars, 0)::BIGINT AS covered, length(text)::BIGINT AS chars FROM texts LEFT JOIN c USING (doc_id)")
def pii_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return _found(spark, sf_dir).select("doc_id", F.size("spans").cast("long").alias("n"), covered.cast("long").alias("covered"), F.col("chars").cast("long").alias("chars"))


@query("top_docs_by_pii", f"{oracle.detected()} SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 20")
def top_docs_by_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", F.size("spans").cast("long").alias("n")).where("n > 0").orderBy(F.desc("n"), "doc_id").limit(20)


@query("entity_cooccurrence", f"{oracle.detected()}, d AS (SELECT DISTINCT doc_id, typ FROM spans) SELECT a.typ AS a, b.typ AS b, count(*) AS docs FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.typ < b.typ GROUP BY ALL")
def entity_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array_sort(F.array_distinct("spans.entity_type"))
    pairs = F.flatten(F.transform(types, lambda a: F.transform(F.filter(types, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return _found(spark, sf_dir).where(F.size("spans") > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("docs"))


@query("entity_types_in_use", f"{oracle.detected()} SELECT array_to_string(list_sort(list(DISTINCT typ)), ',') AS types FROM spans")
def entity_types_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans.entity_type")))), ",").alias("types"))


# Threats.  Texts are documents and pages, with a risky line in some of them.

_RISKS = {
    "threat_sql": ("CASE doc_id % 7 WHEN 0 THEN 'x; drop   table y' WHEN 1 THEN 'ALTER TABLE a DROP b' WHEN 2 THEN 'copy x from program z' WHEN 3 THEN '/*!5 x */' WHEN 4 THEN 'exec  (x)' WHEN 5 THEN 'dropped tables' ELSE '' END", threats.check_sql),
    "threat_text_script": ("CASE doc_id % 7 WHEN 0 THEN '<SCRIPT src' WHEN 1 THEN '<?php x' WHEN 2 THEN '<% =' WHEN 3 THEN 'a IEX (x' WHEN 4 THEN 'TVqQ' || repeat('A', 40) WHEN 5 THEN 'see javascript:x' ELSE '<scripts' END", threats.check_text),
}
_RISKY = "SELECT doc_id, text || chr(10) || {} AS text FROM documents"


def _first_of(pattern: str, chars: int, text: str = "text") -> str:
    return f"substr(trim(regexp_extract({text}, {oracle.quoted('(?i)' + pattern)}), ' ' || chr(9) || chr(10)), 1, {chars})"


_THREAT_SQL = {
    "threat_sql": f"CASE WHEN regexp_matches(text, {oracle.quoted('(?i)' + threats.SQL_DESTRUCTIVE)}) THEN 'Destructive SQL statement detected: \"' || {_first_of(threats.SQL_DESTRUCTIVE, 60)} || '\"' WHEN contains(text, '/*!') THEN 'MySQL conditional comment obfuscation detected in SQL' END",
    "threat_text_script": f"CASE WHEN regexp_matches(text, {oracle.quoted('(?i)' + threats.TEXT_SCRIPT)}) THEN 'Embedded script/code detected in text file: \"' || {_first_of(threats.TEXT_SCRIPT, 40)} || '\"' WHEN regexp_matches(text, {oracle.quoted(threats.BASE64_PE)}) THEN 'Base64-encoded executable payload detected in text file' WHEN regexp_matches(text, {oracle.quoted('(?i)' + threats.TEXT_SCHEMES)}) THEN 'Suspicious URI scheme detected in text file' END",
}


def _one_risk(name: str) -> None:
    risk, check = _RISKS[name]

    @query(name, f"SELECT doc_id, {_THREAT_SQL[name]} AS reason FROM ({_RISKY.format(risk)})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.sql(_RISKY.format(risk).replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
        return df.select("doc_id", check(F.col("text")).alias("reason"))


for _name in _RISKS:
    _one_risk(_name)


@query("threat_pages", f"SELECT page_id, {_THREAT_SQL['threat_text_script']} AS reason FROM (SELECT page_id, html AS text FROM pages)")
def threat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", threats.check_text(F.col("html")).alias("reason"))


_CELLS = "SELECT c_custkey AS doc_id, 'name,value' || chr(10) || c_name || ',' || CASE c_custkey % 5 WHEN 0 THEN ' \"=HYPERLINK(1)\"' WHEN 1 THEN '=1+1' WHEN 2 THEN '''@x|calc''' WHEN 3 THEN 'plain cmd|' ELSE '-system (x)' END AS text FROM customer"
_CELL_SQL = f"""WITH t AS ({_CELLS}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:2000]) AS line, generate_subscripts(string_split(text, chr(10))[1:2000], 1) AS row FROM t),
  c AS (SELECT doc_id, row, unnest(string_split(line, ',')) AS cell, generate_subscripts(string_split(line, ','), 1) AS col FROM l),
  b AS (SELECT doc_id, row, col, trim(trim(trim(cell), '"'), '''') AS cell FROM c),
  f AS (SELECT doc_id, arg_min({{'row': row, 'cell': cell}}, row * 1000 + col) AS x FROM b WHERE regexp_matches(cell, {oracle.quoted('(?i)' + threats.CSV_FORMULA)}) GROUP BY doc_id)
  SELECT doc_id, 'Formula injection detected in CSV (row ' || x.row || '): "' || substr(x.cell, 1, 80) || '"' AS reason FROM t LEFT JOIN f USING (doc_id)"""


@query("threat_csv_formula", _CELL_SQL)
def threat_csv_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(_CELLS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return df.select("doc_id", threats.check_csv(F.col("text")).alias("reason"))


_NESTED = "SELECT event_id, repeat('[', CAST(event_id % 60 AS INT)) || props || repeat(']', CAST(event_id % 60 AS INT)) AS text FROM events"


@query("threat_json_depth", f"""WITH t AS ({_NESTED}), m AS (SELECT event_id, unnest(regexp_extract_all(text, '[\\[\\]{{}}]')) AS c, generate_subscripts(regexp_extract_all(text, '[\\[\\]{{}}]'), 1) AS i FROM t),
  d AS (SELECT event_id, sum(CASE WHEN c IN ('[', '{{') THEN 1 ELSE -1 END) OVER (PARTITION BY event_id ORDER BY i) AS depth FROM m)
  SELECT event_id, greatest(0, max(depth))::BIGINT AS depth, max(depth) > 50 AS too_deep FROM d GROUP BY event_id""")
def threat_json_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(_NESTED.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")).where(F.col("text").rlike(r"[\[\]{}]"))
    depth = threats.json_depth(F.col("text"))
    return df.select("event_id", depth.cast("long").alias("depth"), (depth > threats.MAX_JSON_DEPTH).alias("too_deep"))


_JSONS = "CASE event_id % 5 WHEN 0 THEN '{\"a\": [{\"__proto__\": 1}]}' WHEN 1 THEN '[\"x javascript:y\"]' WHEN 2 THEN '{\"a\": {\"b\": \"onload = x\"}}' WHEN 3 THEN props ELSE '{broken' END"


@query("threat_json_walk", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Prototype pollution key detected: \"__proto__\"' WHEN 1 THEN 'Script injection detected in JSON value' WHEN 2 THEN 'Script injection detected in JSON value' END AS reason FROM events")
def threat_json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr("event_id", f"{_JSONS} AS text")
    return df.select("event_id", threats.json_scan("text").alias("reason"))


# Files by their first bytes and names.
_HEADS = ["25504446", "4D5A00", "7F454C46", "89504E470D0A1A0A", "FFD8FF", "49492A00", "4D4D002A", "424D", "524946460000000057454250", "474946383761", "474946383961", "0000000066747970", "504B0304", "D0CF11E0A1B11AE1", "23212F62696E2F7368", "68656C6C6F"]
_HEAD_OF = "CASE p_partkey % 16 " + " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(_HEADS)) + " END || '0000000000000000'"
_NAME_OF = "CASE p_partkey % 9 WHEN 0 THEN 'a.TXT' WHEN 1 THEN 'b.exe.csv' WHEN 2 THEN 'c.png' WHEN 3 THEN 'noext' WHEN 4 THEN 'd.e.json' WHEN 5 THEN 'x.scr' WHEN 6 THEN 'y.pdf' WHEN 7 THEN 'z.gif' ELSE 'w.sql' END"


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_NAME_OF} AS filename", f"unhex({_HEAD_OF}) AS content")


_MIME_CASES = " ".join(f"WHEN {cond} THEN '{kind}'" for cond, kind in [("starts_with(h, '25504446')", "application/pdf"), ("starts_with(h, '4D5A')", "application/x-dosexec"), ("starts_with(h, '7F454C46')", "application/x-elf"), ("starts_with(h, '89504E470D0A1A0A')", "image/png"), ("starts_with(h, 'FFD8FF')", "image/jpeg"), ("starts_with(h, '49492A00') OR starts_with(h, '4D4D002A')", "image/tiff"), ("starts_with(h, '424D')", "image/bmp"), ("starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250'", "image/webp"), ("starts_with(h, '474946383761') OR starts_with(h, '474946383961')", "image/gif"), ("substr(h, 9, 8) = '66747970'", "image/heic"), ("starts_with(h, '504B0304')", "application/zip"), ("starts_with(h, 'D0CF11E0A1B11AE1')", "application/vnd.ms-excel")])


@query("threat_magic_mime", f"SELECT p_partkey, CASE {_MIME_CASES} ELSE '' END AS mime FROM (SELECT p_partkey, {_HEAD_OF} AS h FROM part)")
def threat_magic_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heads(spark, sf_dir).select("p_partkey", threats.mime(F.col("content")).alias("mime"))


_EXT = "lower(regexp_extract({0}, '[^./][^/]*?([.][^./]*)$', 1))"
_NAMES = f"SELECT p_partkey, n, {_EXT.format('n')} AS ext, {_EXT.format(chr(34) + 'stem' + chr(34))} AS inner_ext, CASE WHEN contains(n, '.') THEN '.' || lower(string_split(n, '.')[-1]) ELSE '' END AS route FROM (SELECT p_partkey, {_NAME_OF} AS n, regexp_replace({_NAME_OF}, '[.][^.]*$', '') AS stem FROM part)"
_ALLOWED = ", ".join(map(oracle.quoted, threats.EXTENSIONS))
_INNER = ", ".join(map(oracle.quoted, threats.DANGEROUS_INNER))
_EXT_REASON = f"CASE WHEN ext NOT IN ({_ALLOWED}) THEN 'File type \"' || ext || '\" is not allowed' WHEN inner_ext IN ({_INNER}) THEN 'Double extension detected (\"' || inner_ext || ext || '\")' END"


@query("threat_extension", f"SELECT p_partkey, ext, inner_ext, route, {_EXT_REASON} AS reason FROM ({_NAMES})")
def threat_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("filename")
    return _heads(spark, sf_dir).select("p_partkey", threats.scan_extension(n).alias("ext"), threats.inner_extension(n).alias("inner_ext"), threats.route_extension(n).alias("route"), threats.check_type(n, F.lit(b"x")).alias("reason"))


_EXE = " ".join(f"WHEN starts_with(h, '{m}') THEN 'File is a {w}'" for m, w in threats.EXECUTABLES) + " WHEN starts_with(h, '23212F62696E2F') THEN 'File is a script (shebang detected)'"
_BAD = "CASE WHEN ext = '.png' AND NOT starts_with(h, '89504E470D0A1A0A') THEN 'Invalid PNG file (bad magic bytes)' WHEN ext = '.pdf' AND NOT starts_with(h, '25504446') THEN 'Invalid PDF (missing PDF header)' WHEN ext = '.gif' AND NOT (starts_with(h, '474946383761') OR starts_with(h, '474946383961')) THEN 'Invalid GIF file (bad magic bytes)' END"


@query("threat_first_reason", f"SELECT p_partkey, coalesce({_EXT_REASON}, CASE {_EXE} END, {_BAD}) IS NULL AS is_safe, coalesce({_EXT_REASON}, CASE {_EXE} END, {_BAD}, '') AS reason FROM ({_NAMES}) JOIN (SELECT p_partkey, {_HEAD_OF} AS h FROM part) USING (p_partkey)")
def threat_first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen(_heads(spark, sf_dir)).select("p_partkey", "is_safe", "reason")


@query("threat_png_pixels", "SELECT p_partkey, (p_size * 400)::BIGINT AS width, (p_partkey % 9000)::BIGINT AS height, (p_size * 400)::BIGINT * (p_partkey % 9000) > 100000000 AS too_large FROM part")
def threat_png_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = "lpad(hex({}), 8, '0')"
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", f"unhex('89504E470D0A1A0A0000000D49484452' || {four.format('p_size * 400')} || {four.format('p_partkey % 9000')}) AS content")
    w, h = threats.png_pixels(F.col("content"))
    return df.select("p_partkey", w.alias("width"), h.alias("height"), threats.check_image(F.lit(".png"), F.col("content")).isNotNull().alias("too_large"))


_PDFS = "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '%PDF /JavaScript' WHEN 1 THEN '%PDF /OpenAction /JSX' WHEN 2 THEN '%PDF /Launch' WHEN 3 THEN '%PDF /EmbeddedFile /Filespec' WHEN 4 THEN '%PDF /URI (vbscript:' WHEN 5 THEN 'PDF' WHEN 6 THEN '%PDF /AA> x' ELSE '%PDF fine' END AS text FROM part"


@query("threat_pdf", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'JavaScript detected in PDF' WHEN 1 THEN 'Auto-execution action with script detected in PDF' WHEN 2 THEN 'Launch action detected in PDF (potential command execution)' WHEN 3 THEN 'Embedded file detected in PDF' WHEN 4 THEN 'Suspicious URI scheme detected in PDF' WHEN 5 THEN 'Invalid PDF (missing PDF header)' END AS reason FROM part")
def threat_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(_PDFS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return df.select("p_partkey", threats.check_pdf(F.col("text").cast("binary")).alias("reason"))


@query("threat_ooxml")
def threat_ooxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office files made from the nation table by a Python function, then screened."""
    import io
    import zipfile

    @F.udf(T.BinaryType())
    def office(k: int) -> bytes:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", "=CMD|x" if k % 3 == 0 else "fine")
            z.writestr("xl/vbaProject.bin" if k % 3 == 1 else "xl/other.bin", "x")
        return buf.getvalue()

    df = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("a.xlsx").alias("filename"), office("n_nationkey").alias("content"))
    return screening.screen(df).select("n_nationkey", "is_safe", "reason")


# Files, units and batches.


def _csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each supplier: a quoted, ragged CSV."""
    body = "'name,email' || chr(10) || '\"' || s_name || ', Asha\",a' || s_suppkey || '@b.org' || chr(10) || '\"two' || chr(10) || 'lines\",10.0.0.' || (s_suppkey % 256) || ',extra'"
    return table(spark, sf_dir, "supplier").selectExpr("'f' || s_suppkey AS file_id", "'data.csv' AS filename", f"cast({body} AS binary) AS content")


_CSV_CLEAN = "'name,email' || chr(13) || chr(10) || '\"' || regexp_replace(s_name, '[0-9]{9,18}', '[REDACTED]') || ', Asha\",[REDACTED]' || chr(13) || chr(10) || '\"two' || chr(10) || 'lines\",[REDACTED],extra' || chr(13) || chr(10)"


@query("sanitize_csv_cells", f"SELECT 'f' || s_suppkey AS file_id, {_CSV_CLEAN} AS clean, 3::BIGINT AS pii_count FROM supplier")
def sanitize_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = filing.sanitize_files(_csv_files(spark, sf_dir), "redact")
    return done.select("file_id", F.col("sanitized").cast("string").alias("clean"), "pii_count")


@query("csv_units", "SELECT 'f' || s_suppkey AS file_id, unnest([0, 1, 2, 3, 4, 5, 6])::BIGINT AS seq, unnest(['0,0', '0,1', '1,0', '1,1', '2,0', '2,1', '2,2']) AS addr, unnest(['name', 'email', s_name || ', Asha', 'a' || s_suppkey || '@b.org', 'two' || chr(10) || 'lines', '10.0.0.' || (s_suppkey % 256), 'extra']) AS text FROM supplier")
def csv_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing.explode_units(_csv_files(spark, sf_dir)).select("file_id", "seq", "addr", "text")


@query("sanitize_json_values", "SELECT 's' || s_suppkey AS file_id, '{' || chr(10) || '  \"n\": ' || s_suppkey || ',' || chr(10) || '  \"mail\": \"[REDACTED]\",' || chr(10) || '  \"l\": [' || chr(10) || '    \"ip [REDACTED]\",' || chr(10) || '    true' || chr(10) || '  ]' || chr(10) || '}' AS clean, 2::BIGINT AS pii_count FROM supplier")
def sanitize_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "'{\"n\": ' || s_suppkey || ', \"mail\": \"a' || s_suppkey || '@b.org\", \"l\": [\"ip 10.0.0.' || (s_suppkey % 256) || '\", true]}'"
    df = table(spark, sf_dir, "supplier").selectExpr("'s' || s_suppkey AS file_id", "'data.json' AS filename", f"cast({body} AS binary) AS content")
    return filing.sanitize_files(df, "redact").select("file_id", F.col("sanitized").cast("string").alias("clean"), "pii_count")


@query("sanitize_sql_literals", "SELECT 's' || s_suppkey AS file_id, '-- a@b.org' || chr(10) || 'INSERT INTO t VALUES (' || s_suppkey || ', ''[REDACTED]'', \"x\");' || chr(10) || 'SELECT ''it''''s'';' AS clean, 1::BIGINT AS pii_count FROM supplier")
def sanitize_sql_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "'-- a@b.org' || chr(10) || 'INSERT INTO t VALUES (' || s_suppkey || ', ''a' || s_suppkey || '@b.org'', \"x\");  ' || chr(10) || chr(10) || 'SELECT ''it''''s'';'"
    df = table(spark, sf_dir, "supplier").selectExpr("'s' || s_suppkey AS file_id", "'data.sql' AS filename", f"cast({body} AS binary) AS content")
    return filing.sanitize_files(df, "redact").select("file_id", F.col("sanitized").cast("string").alias("clean"), "pii_count")


@query("format_router", f"SELECT p_partkey, CASE route WHEN '.txt' THEN 'text' WHEN '.csv' THEN 'csv' WHEN '.json' THEN 'json' WHEN '.sql' THEN 'sql' END AS format, CASE WHEN route = '.pdf' THEN '.pdf needs a PDF library' WHEN route IN ('.png', '.gif') THEN route || ' needs an OCR engine' WHEN route IN ('.txt', '.csv', '.json', '.sql') THEN NULL ELSE 'Unsupported format: ' || route END AS problem FROM ({_NAMES})")
def format_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing.route(_heads(spark, sf_dir)).select("p_partkey", "format", "problem")


@query("download_mime", f"SELECT p_partkey, CASE route WHEN '.txt' THEN 'text/plain' WHEN '.csv' THEN 'text/csv' WHEN '.json' THEN 'application/json' WHEN '.sql' THEN 'text/plain' WHEN '.pdf' THEN 'application/pdf' WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' ELSE 'application/octet-stream' END AS mime FROM ({_NAMES})")
def download_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heads(spark, sf_dir).select("p_partkey", filing.download_mime(F.col("filename")).alias("mime"))


@query("encrypted_round_trip", "SELECT c_custkey AS file_id, c_name AS content, true AS hidden FROM customer")
def encrypted_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").cast("binary").alias("content"))
    key = "0123456789abcdef"
    locked = filing.encrypted(df, key)
    hidden = locked.select("file_id", (~F.contains("content", F.lit(b"Customer"))).alias("hidden"), "content")
    return hidden.select("file_id", F.aes_decrypt("content", F.lit(key)).cast("string").alias("content"), "hidden")


_TURNS = "SELECT conv_id AS file_id, turn AS seq, text FROM conversations"
_BATCH = 600


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").alias("seq"), "text")


_BATCHED = f"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, turn, text, length(text) + 3 AS n FROM conversations WHERE regexp_matches(text, '\\S')),
  w AS (SELECT conv_id, i, turn, text, n AS size, 0 AS batch FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.i, t.turn, t.text, CASE WHEN w.size + t.n > {_BATCH} THEN t.n ELSE w.size + t.n END, CASE WHEN w.size + t.n > {_BATCH} THEN w.batch + 1 ELSE w.batch END FROM w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1)"""


@query("batch_greedy", f"{_BATCHED} SELECT conv_id::VARCHAR AS file_id, batch::BIGINT AS batch, count(*) AS texts, length(string_agg(text, chr(10) || chr(1) || chr(10)))::BIGINT AS chars FROM w GROUP BY conv_id, batch")
def batch_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.batches(_turns(spark, sf_dir), _BATCH).select("file_id", F.col("batch").cast("long").alias("batch"), F.size("seqs").cast("long").alias("texts"), F.length("text").cast("long").alias("chars"))


@query("batch_roundtrip", "SELECT conv_id::VARCHAR AS file_id, turn::BIGINT AS seq, text FROM conversations WHERE regexp_matches(text, '\\S')")
def batch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.split_batches(geometry.batches(_turns(spark, sf_dir), _BATCH)).withColumn("seq", F.col("seq").cast("long"))


# Lines of images, tokens of models.


@query("ocr_conf_filter", f"SELECT doc_id, count(*) AS lines, string_agg(regexp_replace(text, '\\s+$', ''), chr(10) ORDER BY line_idx, text) AS text FROM ({views.LINES}) WHERE confidence >= 0.5 GROUP BY doc_id")
def ocr_conf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.ocr_lines(spark, sf_dir)
    counts = geometry.confident(lines).groupBy("doc_id").agg(F.count("*").alias("lines"))
    return geometry.line_text(lines).join(counts, "doc_id")


@query("ocr_box_rect", f"SELECT doc_id, line_idx, x1::BIGINT AS x, y1::BIGINT AS y, greatest(1, x2 - x1)::BIGINT AS w, greatest(1, y2 - y1)::BIGINT AS h FROM ({views.LINES})")
def ocr_box_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = geometry.box_rect(F.col("box"))
    return views.ocr_lines(spark, sf_dir).select("doc_id", "line_idx", *[r[c].cast("long").alias(c) for c in "xywh"])


_PLACED = f"WITH l AS (SELECT doc_id, line_idx, trim(text) AS text, x1, y1, x2 - x1 AS w, y2 - y1 AS h FROM ({views.LINES}) WHERE trim(text) <> ''), p AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l), s AS (SELECT DISTINCT doc_id, unnest(['PERSON', 'IP_ADDRESS']) AS entity_type, unnest([6, 25]) AS s, unnest([20, 60]) AS e FROM l)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = geometry.line_offsets(views.ocr_lines(spark, sf_dir))
    found = F.array(F.struct(F.lit("PERSON").alias("entity_type"), F.lit(6).alias("start"), F.lit(20).alias("end")), F.struct(F.lit("IP_ADDRESS").alias("entity_type"), F.lit(25).alias("start"), F.lit(60).alias("end")))
    ents = lines.select("doc_id").distinct().select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")
    return geometry.overlapping(ents, lines)


@query("ocr_lines_overlap", f"{_PLACED} SELECT doc_id, entity_type, line_idx, a::BIGINT AS char_start, (a + length(text))::BIGINT AS char_end FROM s JOIN p USING (doc_id) WHERE a < e AND a + length(text) > s")
def ocr_lines_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("doc_id", "entity_type", "line_idx", "char_start", "char_end")


@query("image_sub_boxes", f"""{_PLACED}, o AS (SELECT *, greatest(s, a) - a AS f, least(e, a + length(text)) - a AS t, length(text) AS n, greatest(1, w)::BIGINT AS bw, greatest(1, h)::BIGINT AS bh FROM s JOIN p USING (doc_id) WHERE a < e AND a + length(text) > s)
  SELECT doc_id, line_idx, entity_type, trunc(x1 + f / n * bw)::BIGINT AS x, y1::BIGINT AS y, greatest(trunc((t / n - f / n) * bw), 2)::BIGINT AS w, bh AS h, substr(text, (f + 1)::BIGINT, (t - f)::BIGINT) AS part FROM o WHERE bw >= 2 AND bh >= 2""")
def image_sub_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.sub_boxes(_placed(spark, sf_dir))


@query("ocr_rstrip_lines", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), chr(10)) AS text FROM documents")
def ocr_rstrip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", geometry.rstrip_lines(F.col("text")).alias("text"))


@query("ocr_postprocess")
def ocr_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", geometry.postprocess(F.col("text")).alias("text"))


@query("median_colours", f"SELECT doc_id, trunc(quantile_cont(r, 0.5))::BIGINT AS r, trunc(quantile_cont(g, 0.5))::BIGINT AS g, trunc(quantile_cont(b, 0.5))::BIGINT AS b FROM ({views.PIXELS}) GROUP BY doc_id")
def median_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.median_colours(views.from_lines(spark, sf_dir, views.PIXELS))


_KIND = "CASE WHEN \"start\" = 0 AND \"end\" = 0 THEN NULL WHEN label IN ('B-NAME_STUDENT', 'I-NAME_STUDENT') THEN 'NAME' WHEN label IN ('B-EMAIL', 'I-EMAIL') THEN 'EMAIL_ADDRESS' WHEN label = 'B-STREET_ADDRESS' THEN 'LOCATION' END"
_BIO = f"""WITH k AS (SELECT *, {_KIND} AS typ FROM ({views.TOKENS})), c AS (SELECT *, CASE WHEN typ IS NOT DISTINCT FROM lag(typ) OVER (PARTITION BY doc_id ORDER BY idx) AND row_number() OVER (PARTITION BY doc_id ORDER BY idx) > 1 THEN 0 ELSE 1 END AS n FROM k),
  r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM c),
  b AS (SELECT doc_id, typ, arg_min("start", idx) AS s, arg_max("end", idx) AS e FROM r WHERE typ IS NOT NULL GROUP BY doc_id, run, typ)"""


@query("bio_decode", f"{_BIO} SELECT doc_id, typ AS entity_type, s::BIGINT AS span_start, e::BIGINT AS span_end FROM b")
def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.bio_spans(views.from_lines(spark, sf_dir, views.TOKENS))
    return found.select("doc_id", "entity_type", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"))


@query("adjacent_merge", f"{_BIO}, j AS (SELECT *, CASE WHEN lag(typ) OVER o = typ AND s - lag(e) OVER o <= 2 THEN 0 ELSE 1 END AS n FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY s, e)), g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY s, e) AS run FROM j) SELECT doc_id, typ AS entity_type, min(s)::BIGINT AS span_start, arg_max(e, s)::BIGINT AS span_end FROM g GROUP BY doc_id, run, typ")
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.merge_neighbours(geometry.bio_spans(views.from_lines(spark, sf_dir, views.TOKENS)), 2)
    return found.select("doc_id", "entity_type", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"))


@query("model_windows", """WITH RECURSIVE t AS (SELECT doc_id, text, length(text)::BIGINT AS n FROM documents),
  w AS (SELECT doc_id, text, n, 0::BIGINT AS a, CASE WHEN n <= 3500 THEN n ELSE coalesce(2800 + nullif(length(regexp_extract(substr(text, 2801, 700), '(?s)^(.* )', 1)), 0), 3500) END::BIGINT AS e FROM t WHERE n > 0
    UNION ALL SELECT doc_id, text, n, b, CASE WHEN n <= b + 3500 THEN n ELSE b + coalesce(2800 + nullif(length(regexp_extract(substr(text, b + 2801, 700), '(?s)^(.* )', 1)), 0), 3500) END::BIGINT FROM (SELECT *, greatest(a + 1, e - 700) AS b FROM w WHERE e < n))
  SELECT doc_id, a AS span_start, e AS span_end FROM w""")
def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", F.explode(geometry.windows(F.col("text"))).alias("w"))
    return df.select("doc_id", F.col("w.start").cast("long").alias("span_start"), F.col("w.end").cast("long").alias("span_end"))


# The catalog.
_C = ", ".join(f"{n} AS ({sql})" for n, sql in views.CATALOG_DUCK.items())


def _cat(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [views.catalog(spark, sf_dir, n) for n in names]


@query("files_visible", f"WITH {_C} SELECT id, original_filename, upload_by, pii_count::BIGINT AS pii_count FROM files WHERE upload_by = 'u7' OR upload_by IN (SELECT id FROM users WHERE role = 'admin')")
def files_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, u = _cat(spark, sf_dir, "files", "users")
    return cat.visible_files(f, u, "u7", "user").select("id", "original_filename", "upload_by", F.col("pii_count").cast("long").alias("pii_count"))


@query("files_access", f"WITH {_C} SELECT f.id, f.upload_by = 'u7' OR coalesce(u.role = 'admin', false) AS may_download, f.upload_by = 'u7' AS may_delete FROM files f LEFT JOIN users u ON f.upload_by = u.id")
def files_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.access(*_cat(spark, sf_dir, "files", "users"), "u7", "user").select("id", "may_download", "may_delete")


_VERIFIED = f"WITH {_C}, v AS (SELECT f.id, original_filename, CASE WHEN o.content IS NULL THEN 'missing' WHEN sha256(o.content) = original_hash THEN 'intact' ELSE 'tampered' END AS original, CASE WHEN s.content IS NULL THEN 'missing' WHEN sha256(s.content) = sanitized_hash THEN 'intact' ELSE 'tampered' END AS sanitized FROM files f LEFT JOIN originals o ON o.file_id = f.id LEFT JOIN sanitized s ON s.file_id = f.id)"


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, o, s = _cat(spark, sf_dir, "files", "originals", "sanitized")
    return cat.verify(f, o, s)


@query("files_verify", f"{_VERIFIED} SELECT * FROM v")
def files_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir)


@query("files_tampered_log", f"{_VERIFIED} SELECT 'u50' AS user_id, 'file_tampered' AS action, original_filename AS target_file, 'Integrity check: original=' || original || ', sanitized=' || sanitized AS details FROM v WHERE original = 'tampered' OR sanitized = 'tampered'")
def files_tampered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.tamper_log(_verified(spark, sf_dir), "u50")


@query("files_after_delete", f"WITH {_C} SELECT id, upload_by FROM files WHERE id <> 'f5'")
def files_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.without(*_cat(spark, sf_dir, "files"), "f5", "u50", "admin").select("id", "upload_by")


@query("files_search", f"WITH {_C} SELECT id, original_filename FROM files WHERE contains(lower(original_filename), 'urgent') AND contains(lower(original_filename), '.txt')")
def files_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.search(cat.search(*_cat(spark, sf_dir, "files"), "URGENT"), ".txt").select("id", "original_filename")


@query("files_public", f"WITH {_C} SELECT id, original_filename, upload_by, mode, pii_count::BIGINT AS pii_count, original_hash, sanitized_hash, created_at FROM files")
def files_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.file_rows(*_cat(spark, sf_dir, "files")).withColumn("pii_count", F.col("pii_count").cast("long"))


@query("audit_named", f"WITH {_C} SELECT l.id, user_id, action, timestamp, coalesce(username, user_id) AS who FROM logs l LEFT JOIN users u ON u.id = l.user_id")
def audit_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.named_logs(*_cat(spark, sf_dir, "logs", "users")).select("id", "user_id", "action", "timestamp", "who")


@query("audit_recent", f"WITH {_C} SELECT id, action, timestamp FROM logs ORDER BY timestamp DESC, id DESC LIMIT 5")
def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.newest(*_cat(spark, sf_dir, "logs"), "timestamp", 5).select("id", "action", "timestamp")


@query("audit_by_action", f"WITH {_C} SELECT action, count(*) AS n, count(DISTINCT user_id) AS users FROM logs GROUP BY action")
def audit_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.catalog(spark, sf_dir, "logs").groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("dashboard_totals", f"WITH {_C} SELECT (SELECT count(*) FROM files) AS files, (SELECT sum(pii_count) FROM files)::BIGINT AS pii, (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM logs) AS logs")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.totals(*_cat(spark, sf_dir, "files", "users", "logs"))


@query("user_uniqueness", f"WITH {_C} SELECT 'username' AS field, username AS value, count(*) AS count FROM users GROUP BY username HAVING count(*) > 1 UNION ALL SELECT 'email', email, count(*) FROM users GROUP BY email HAVING count(*) > 1")
def user_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.duplicates(*_cat(spark, sf_dir, "users"))


@query("user_lookup", f"WITH {_C} SELECT id, username FROM users WHERE username = 'nobody' OR email = 'u7@example.org'")
def user_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.is_taken(*_cat(spark, sf_dir, "users"), "nobody", "u7@example.org").select("id", "username")


# Streams and SQL users.


@query("stream_redact", oracle.rewritten("'[REDACTED]'", _DOCS))
def stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, rewritten micro-batch by micro-batch into a table in the shared folder."""
    import tempfile

    from ..streaming import run_available, sanitize_stream

    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='cloakwork-stream-')}"
    at = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    done = sanitize_stream(stream.select("doc_id", "text"), "redact").select("doc_id", "clean", F.col("n_spans").cast("long").alias("n_spans"))
    run_available(done, lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/state")
    return spark.read.schema("doc_id long, clean string, n_spans long").parquet(f"{at}/out").select("doc_id", "clean", "n_spans")


@query("detect_udtf", f"{oracle.detected(views.RECORDS)} {_ROWS} spans")
def detect_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.sql import register

    register(spark)
    keys = detection.spread(table(spark, sf_dir, "customer").select("c_custkey"))  # keys, not texts, go through the shuffle
    rows = keys.selectExpr("c_custkey AS doc_id", f"{views.RECORD} AS text")
    found = spark.sql("SELECT t.doc_id, s.entity_type, s.start AS span_start, s.`end` AS span_end, s.score FROM {t} t, LATERAL detect_spans(t.text) s", t=rows)
    return found.withColumns({c: F.col(c).cast("long") for c in ("span_start", "span_end")})


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items() if sql}
