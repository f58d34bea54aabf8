"""Files as DataFrames: ingest, units, rewriting, stores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import threats
from ..operators.detection import sanitize
from . import formats

MODES = ("redact", "mask", "tokenize")
# MIME types of downloads, by extension.
DOWNLOAD_MIMES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".ppt": "application/vnd.ms-powerpoint",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
    ".sql": "text/plain",
    ".csv": "text/csv",
    ".json": "application/json",
    ".txt": "text/plain",
    ".xml": "text/xml",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".bmp": "image/bmp",
    ".webp": "image/webp",
    ".gif": "image/gif",
    ".heic": "image/heic",
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, filename, content, original_hash) of the files at a path."""
    df = spark.read.format("binaryFile").load(path)
    return as_files(df.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content"))


def as_files(df: DataFrame) -> DataFrame:
    """Adds a stable id and the hash of the content."""
    hashed = F.sha2("content", 256)
    name = F.col("path") if "path" in df.columns else F.col("filename")
    return df.select(F.sha2(F.concat_ws("|", name, hashed), 256).alias("file_id"), "filename", "content", hashed.alias("original_hash"))


def route(files: DataFrame) -> DataFrame:
    """files with `format` (null if unsupported) and `problem`."""
    ext = threats.route_extension(F.col("filename"))
    known = F.create_map(*[F.lit(x) for pair in formats.FORMATS.items() for x in pair])
    needs = F.create_map(*[F.lit(x) for pair in formats.NEEDS.items() for x in pair])
    found = F.try_element_at(known, ext)
    problem = F.when(found.isNull(), F.coalesce(F.concat(ext, F.lit(" needs "), F.try_element_at(needs, ext)), F.concat(F.lit("Unsupported format: "), ext)))
    return files.withColumns({"format": found, "problem": problem})


_UNITS = "file_id string, seq long, addr string, text string, problem string"


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file_id, kind, content in zip(batch["file_id"], batch["format"], batch["content"]):
            try:
                rows += [(file_id, k, addr, text, None) for k, (addr, text) in enumerate(formats.HANDLERS[kind][0](bytes(content)))]
            except Exception as e:  # noqa: BLE001  a broken file is reported, and the others go on
                rows.append((file_id, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["file_id", "seq", "addr", "text", "problem"]).astype({"seq": "Int64"})


def explode_units(files: DataFrame) -> DataFrame:
    """(file_id, seq, addr, text) of each text unit; a file that can't be read has one row with a problem.

    Text files are decoded natively; other formats in Python, an Arrow batch at a time.
    """
    routed = route(files).where("format is not null and content is not null")
    plain = routed.where("format = 'text'").select("file_id", F.lit(0).cast("long").alias("seq"), F.lit("").alias("addr"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(None).cast("string").alias("problem"))
    others = routed.where("format <> 'text'").select("file_id", "format", "content").mapInPandas(_explode, _UNITS)
    return plain.unionByName(others)


def _implode(files: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for file_id, kind, content in zip(files["file_id"], files["format"], files["content"]):
        ordered = units.sort_values("seq")
        try:
            rows.append((file_id, formats.HANDLERS[kind][1](bytes(content), list(ordered["clean"])), int(ordered["n_spans"].sum()), None))
        except Exception as e:  # noqa: BLE001  a broken file is reported, and the others go on
            rows.append((file_id, None, 0, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["file_id", "sanitized", "pii_count", "problem"])


def implode_units(files: DataFrame, units: DataFrame) -> DataFrame:
    """(file_id, sanitized, pii_count, problem): files with their units' `clean` texts.  A file is one row, so a group is as large as a file."""
    routed = route(files).where("format is not null and content is not null").select("file_id", "format", "content")
    return routed.groupBy("file_id").cogroup(units.groupBy("file_id")).applyInPandas(_implode, "file_id string, sanitized binary, pii_count long, problem string")


def sanitize_files(files: DataFrame, mode: str = "redact") -> DataFrame:
    """(file_id, sanitized, pii_count, problem) of each supported file."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    units = explode_units(files)
    good = sanitize(units.where("problem is null"), mode, key="file_id")
    return implode_units(files, good.select("file_id", "seq", "clean", "n_spans"))


def ingest(files: DataFrame, mode: str, user_id: str, key: str) -> dict[str, DataFrame]:
    """Screening, rewriting and the rows of the catalog: `rejected`, `files`, `raw` (encrypted), `sanitized`, `audit`.

    files: (file_id, filename, content, original_hash).  key: 16, 24 or 32 characters for AES.
    """
    from ..operators.screening import screen

    screened = screen(files)
    rejected, good = screened.where(~F.col("is_safe")), screened.where("is_safe")
    done = sanitize_files(good, mode)
    rows = good.join(done, "file_id", "left")
    stored = rows.select(F.col("file_id").alias("id"), F.col("filename").alias("original_filename"), F.concat(F.lit("raw/"), "file_id").alias("encrypted_path"), F.when(F.col("sanitized").isNotNull(), F.concat(F.lit("sanitized/"), "file_id")).alias("sanitized_path"), F.lit(user_id).alias("upload_by"), F.lit(mode).alias("mode"), F.coalesce("pii_count", F.lit(0)).cast("int").alias("pii_count"), "original_hash", F.sha2("sanitized", 256).alias("sanitized_hash"), F.current_timestamp().alias("created_at"))

    def logged(df: DataFrame, action: str, name: str, details: Column) -> DataFrame:
        return df.select(F.lit(user_id).alias("user_id"), F.lit(action).alias("action"), F.col(name).alias("target_file"), details.alias("details"), F.current_timestamp().alias("timestamp"))

    audit = logged(rejected, "file_rejected", "filename", F.col("reason")).unionByName(logged(stored, "upload", "original_filename", F.lit(None).cast("string"))).unionByName(logged(stored, "pii_detection", "original_filename", F.concat(F.lit("Detected "), F.col("pii_count").cast("string"), F.lit(f" PII entities, mode={mode}"))))
    return {"rejected": rejected.select("file_id", "filename", "reason"), "files": stored, "raw": encrypted(good, key), "sanitized": done, "audit": audit}


def encrypted(files: DataFrame, key: str) -> DataFrame:
    """(file_id, content) with the content encrypted by AES-GCM."""
    return files.select("file_id", F.aes_encrypt("content", F.lit(key)).alias("content"))


def decrypted(files: DataFrame, key: str) -> DataFrame:
    return files.select("file_id", F.aes_decrypt("content", F.lit(key)).alias("content"))


def download_mime(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DOWNLOAD_MIMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, threats.route_extension(name)), F.lit("application/octet-stream"))


def write_store(df: DataFrame, path: str) -> None:
    """Appends rows of (file_id, content) as Parquet."""
    df.write.mode("append").parquet(path)
