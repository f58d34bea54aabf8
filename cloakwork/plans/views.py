"""Tables derived from the test tables by expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digits(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {n}, '0')"


_K = "c_custkey"
_FIRST = f"CASE {_K} % 5 WHEN 0 THEN 'Asha' WHEN 1 THEN 'Ravi' WHEN 2 THEN 'Meera' WHEN 3 THEN 'Arjun' ELSE 'Noor' END"
_LAST = f"CASE ({_K} * 7) % 4 WHEN 0 THEN 'Rao' WHEN 1 THEN 'Khan' WHEN 2 THEN 'Iyer' ELSE 'Das' END"
_MONTH = f"CASE {_K} % 3 WHEN 0 THEN 'May' WHEN 1 THEN 'June' ELSE 'October' END"
_FIELDS = [
    ("Name", f"{_FIRST} || ' ' || {_LAST}"),
    ("DOB", f"CAST(1 + {_K} % 28 AS STRING) || ' ' || {_MONTH} || ' ' || CAST(1950 + {_K} % 50 AS STRING)"),
    ("Mobile", f"'+91 9' || {_digits(_K, 9)}"),
    ("Email", f"lower({_FIRST}) || CAST({_K} AS STRING) || '@example.org'"),
    ("Address", f"CAST({_K} AS STRING) || ' Lake Road, Pune'"),
    ("PAN", f"'ABCDE' || {_digits(f'{_K} % 10000', 4)} || 'F'"),
    ("Aadhaar", f"{_digits(f'{_K} % 10000', 4)} || ' 2222 3333'"),
    ("Passport", f"'Z' || {_digits(_K, 7)}"),
    ("Bank", "'Demo Bank'"),
    ("Account", f"'7000000' || {_digits(_K, 7)}"),
    ("IFSC", f"'DEMO0' || {_digits(_K, 6)}"),
    ("UPI", f"lower({_FIRST}) || CAST({_K} AS STRING) || '@demoupi'"),
    ("IP", f"'10.' || CAST({_K} % 256 AS STRING) || '.3.7'"),
    ("Device ID", f"'android-' || {_digits(_K, 10)}"),
    ("Fingerprint", f"'fp_hash_' || {_digits(_K, 12)}"),
    ("Face Template", f"'face_tmp_' || {_digits(_K, 8)}"),
]
_PROSE = f"'On 2024-01-' || {_digits(f'1 + {_K} % 28', 2)} || ' Mr. ' || {_FIRST} || ' ' || {_LAST} || ' paid with 4111-1111-1111-' || {_digits(f'{_K} % 10000', 4)} || ' from 192.168.0.' || CAST({_K} % 256 AS STRING) || '; imei 35' || {_digits(_K, 13)} || ', ref ' || md5(CAST({_K} AS STRING)) || ', sum ' || md5(CAST({_K} AS STRING)) || md5('x' || CAST({_K} AS STRING)) || ', id 0123ABCD-0000-4000-8000-' || {_digits(_K, 12)} || ', customer ' || {_FIRST} || ' Address: Hill Street City: Agra'"
#: A record with a labelled line for each type, then a line of prose.
RECORD = " || chr(10) || ".join([*(f"'{label}: ' || {value}" for label, value in _FIELDS), _PROSE])
#: Texts with personal data of every type: documents and, from a billion on, records made from customers.
TEXTS = f"SELECT doc_id, text, lang FROM documents UNION ALL SELECT 1000000000 + c_custkey, {RECORD}, 'crm' FROM customer"
RECORDS = f"SELECT c_custkey AS doc_id, {RECORD} AS text FROM customer"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{RECORD} AS text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = records(spark, sf_dir).select((F.col("doc_id") + 1000000000).alias("doc_id"), "text", F.lit("crm").alias("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang").unionByName(made)


def _catalog(sha: str) -> dict[str, str]:
    """users, files, logs, originals and sanitized as SQL; sha: how the engine writes SHA-256 of {}."""
    hashed = sha.format("'body ' || CAST(o_orderkey AS STRING)")
    clean = sha.format("'clean ' || CAST(o_orderkey AS STRING)")
    return {
        "users": "SELECT 'u' || CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 97 = 0 THEN 'Customer#twice' ELSE c_name END AS username, 'u' || CAST(c_custkey AS STRING) || '@example.org' AS email, CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role FROM customer",
        "files": f"SELECT 'f' || CAST(o_orderkey AS STRING) AS id, o_orderpriority || '-' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.TXT' WHEN 2 THEN '.docx' ELSE '.pdf' END AS original_filename, 'u' || CAST(o_custkey AS STRING) AS upload_by, CASE o_orderkey % 3 WHEN 0 THEN 'redact' WHEN 1 THEN 'mask' ELSE 'tokenize' END AS mode, CAST(o_orderkey % 40 AS INT) AS pii_count, {hashed} AS original_hash, {clean} AS sanitized_hash, CAST(CAST(o_orderdate AS DATE) AS STRING) AS created_at FROM orders",
        "logs": "SELECT 'l' || CAST(o_orderkey AS STRING) AS id, 'u' || CAST(o_custkey + (o_orderkey % 5) * 400 AS STRING) AS user_id, CASE o_orderkey % 4 WHEN 0 THEN 'upload' WHEN 1 THEN 'download' WHEN 2 THEN 'view' ELSE 'login' END AS action, CAST(CAST(o_orderdate AS DATE) AS STRING) AS timestamp FROM orders",
        "originals": "SELECT 'f' || CAST(o_orderkey AS STRING) AS file_id, CASE WHEN o_orderkey % 17 = 0 THEN 'changed' ELSE 'body ' || CAST(o_orderkey AS STRING) END AS content FROM orders WHERE o_orderkey % 13 <> 0",
        "sanitized": "SELECT 'f' || CAST(o_orderkey AS STRING) AS file_id, CASE WHEN o_orderkey % 19 = 0 THEN 'changed' ELSE 'clean ' || CAST(o_orderkey AS STRING) END AS content FROM orders WHERE o_orderkey % 11 <> 0",
    }


CATALOG_DUCK = _catalog("sha256({})")
_CATALOG_SPARK = _catalog("sha2({}, 256)")

#: Line items, one for each order and number.
ITEMS = "(SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_discount) AS l_discount FROM lineitem GROUP BY l_orderkey, l_linenumber) AS items"
#: Recognised lines, tokens of a model and pixels, made from line items.
LINES = "SELECT l_orderkey AS doc_id, l_linenumber AS line_idx, CASE WHEN l_linenumber % 5 = 0 THEN '  ' ELSE ' Name: Asha Rao ' || CAST(l_partkey AS STRING) || ' 10.0.0.' || CAST(l_suppkey % 256 AS STRING) || '  ' END AS text, l_discount * 10 AS confidence, CAST(l_partkey % 50 AS DOUBLE) AS x1, CAST(l_suppkey % 30 AS DOUBLE) AS y1, CAST(l_partkey % 50 + l_suppkey % 300 AS DOUBLE) AS x2, CAST(l_suppkey % 30 + l_linenumber * 3 AS DOUBLE) AS y2 FROM " + ITEMS
TOKENS = "SELECT l_orderkey AS doc_id, l_linenumber AS idx, CASE l_partkey % 6 WHEN 0 THEN 'O' WHEN 1 THEN 'B-NAME_STUDENT' WHEN 2 THEN 'I-NAME_STUDENT' WHEN 3 THEN 'B-EMAIL' WHEN 4 THEN 'I-EMAIL' ELSE 'B-STREET_ADDRESS' END AS label, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_linenumber * 6 END AS \"start\", CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_linenumber * 6 + 4 + l_partkey % 3 END AS \"end\" FROM " + ITEMS
PIXELS = "SELECT l_orderkey AS doc_id, l_partkey % 256 AS r, l_suppkey % 256 AS g, (l_partkey + l_suppkey) % 256 AS b FROM " + ITEMS


def _made(spark: SparkSession, sf_dir: str, sql: str, *sources: str) -> DataFrame:
    return spark.sql(sql.replace('"start"', "`start`").replace('"end"', "`end`").replace("FROM orders", "FROM {orders}").replace("FROM customer", "FROM {customer}").replace("FROM lineitem", "FROM {lineitem}"), **{s: table(spark, sf_dir, s) for s in sources})


def catalog(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _made(spark, sf_dir, _CATALOG_SPARK[name], "customer" if name == "users" else "orders")


def from_lines(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return _made(spark, sf_dir, sql, "lineitem")


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINES with boxes of four corners."""
    df = from_lines(spark, sf_dir, LINES)
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    return df.select("doc_id", "line_idx", "text", "confidence", F.array(*[F.array(x, y) for x, y in corners]).alias("box"))
