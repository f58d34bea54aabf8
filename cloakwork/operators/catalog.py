"""Queries over the catalog: users, files, audit logs.

users(id, username, email, role, created_at) · files(id, original_filename, encrypted_path, sanitized_path, upload_by, mode, pii_count,
original_hash, sanitized_hash, created_at) · logs(id, user_id, action, target_file, details, timestamp)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roles and actions.
ROLES = ["admin", "user"]
ACTIONS = ["upload", "login", "download", "pii_detection", "user_created", "view", "file_rejected", "file_tampered"]

_S, _TS = T.StringType(), T.TimestampNTZType()
USERS = T.StructType([T.StructField(c, _S) for c in ("id", "username", "email", "hashed_password", "role")] + [T.StructField("created_at", _TS)])
FILES = T.StructType([T.StructField(c, _S) for c in ("id", "original_filename", "encrypted_path", "sanitized_path", "upload_by", "mode")] + [T.StructField("pii_count", T.IntegerType()), T.StructField("original_hash", _S), T.StructField("sanitized_hash", _S), T.StructField("created_at", _TS)])
LOGS = T.StructType([T.StructField(c, _S) for c in ("id", "user_id", "action", "target_file", "details")] + [T.StructField("timestamp", _TS)])


def user_rows(users: DataFrame) -> DataFrame:
    """What others may see of users."""
    return users.select("id", "username", "email", "role", "created_at")


def file_rows(files: DataFrame) -> DataFrame:
    """What others may see of files: no paths."""
    return files.select("id", "original_filename", "upload_by", "mode", "pii_count", "original_hash", "sanitized_hash", "created_at")


def by_admins(files: DataFrame, users: DataFrame) -> DataFrame:
    return files.join(users.where(F.col("role") == "admin").select(F.col("id").alias("_owner")), F.col("upload_by") == F.col("_owner"), "left_semi")


def visible_files(files: DataFrame, users: DataFrame, user_id: str, role: str) -> DataFrame:
    """All files for an admin; for others their own and those that admins uploaded."""
    if role == "admin":
        return files
    own = files.where(F.col("upload_by") == user_id)
    return own.unionByName(by_admins(files.where(F.col("upload_by") != user_id), users))


def access(files: DataFrame, users: DataFrame, user_id: str, role: str) -> DataFrame:
    """files with may_download and may_delete."""
    owners = users.select(F.col("id").alias("_owner"), (F.col("role") == "admin").alias("_by_admin"))
    wide = files.join(owners, F.col("upload_by") == F.col("_owner"), "left")
    admin, own = F.lit(role == "admin"), F.col("upload_by") == user_id
    return wide.withColumns({"may_download": admin | own | F.coalesce("_by_admin", F.lit(False)), "may_delete": admin | own}).drop("_owner", "_by_admin")


def verdict(content: Column, expected: Column) -> Column:
    """missing, intact or tampered, by SHA-256."""
    return F.when(content.isNull(), "missing").when(F.sha2(content, 256) == expected, "intact").otherwise("tampered")


def verify(files: DataFrame, originals: DataFrame, sanitized: DataFrame) -> DataFrame:
    """id, original_filename, original, sanitized: the verdict on both copies; stores are (file_id, content)."""
    a = originals.select(F.col("file_id").alias("id"), F.col("content").alias("_original"))
    b = sanitized.select(F.col("file_id").alias("id"), F.col("content").alias("_sanitized"))
    return files.join(a, "id", "left").join(b, "id", "left").select("id", "original_filename", verdict(F.col("_original"), F.col("original_hash")).alias("original"), verdict(F.col("_sanitized"), F.col("sanitized_hash")).alias("sanitized"))


def tamper_log(verified: DataFrame, user_id: str) -> DataFrame:
    """Audit rows of files of which a copy was tampered with."""
    details = F.concat(F.lit("Integrity check: original="), "original", F.lit(", sanitized="), "sanitized")
    return verified.where("original = 'tampered' or sanitized = 'tampered'").select(F.lit(user_id).alias("user_id"), F.lit("file_tampered").alias("action"), F.col("original_filename").alias("target_file"), details.alias("details"))


def named_logs(logs: DataFrame, users: DataFrame) -> DataFrame:
    """Logs with the user's name, or the id of a user who is unknown."""
    names = users.select(F.col("id").alias("user_id"), "username")
    return logs.join(names, "user_id", "left").withColumn("who", F.coalesce("username", "user_id")).drop("username")


def newest(df: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """Rows from the newest on; the id decides between equal times."""
    ordered = df.orderBy(F.desc(by), F.desc("id"))
    return ordered.limit(n) if n else ordered


def totals(files: DataFrame, users: DataFrame, logs: DataFrame) -> DataFrame:
    """One row: files, found values, users, logs."""
    a = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("pii_count"), F.lit(0)).cast("long").alias("pii"))
    return a.crossJoin(users.agg(F.count("*").alias("users"))).crossJoin(logs.agg(F.count("*").alias("logs")))  # each has one row


def duplicates(users: DataFrame) -> DataFrame:
    """Names and addresses that more than one user has."""
    names = users.groupBy(F.lit("username").alias("field"), F.col("username").alias("value")).count()
    mails = users.groupBy(F.lit("email").alias("field"), F.col("email").alias("value")).count()
    return names.union(mails).where("count > 1")


def is_taken(users: DataFrame, username: str, email: str) -> DataFrame:
    return users.where((F.col("username") == username) | (F.col("email") == email)).limit(1)


def search(files: DataFrame, text: str) -> DataFrame:
    """Files whose name holds a text, in any case."""
    return files.where(F.lower("original_filename").contains(text.lower()))


def without(files: DataFrame, file_id: str, user_id: str, role: str) -> DataFrame:
    """files after a deletion: the file goes if the user is an admin or its owner."""
    return files if role not in ROLES else files.where((F.col("id") != file_id) | ~(F.lit(role == "admin") | F.col("upload_by").eqNullSafe(user_id)))


def log_rows(df: DataFrame, action: str, target: Column, details: Column | None = None) -> DataFrame:
    """Audit rows to append, one for each row of df(user_id, ...)."""
    if action not in ACTIONS:
        raise ValueError(f"action must be one of {ACTIONS}")
    return df.select(F.uuid().alias("id"), "user_id", F.lit(action).alias("action"), target.alias("target_file"), (details if details is not None else F.lit(None).cast("string")).alias("details"), F.current_timestamp().cast("timestamp_ntz").alias("timestamp"))
