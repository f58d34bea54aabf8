"""Rewriting a text where its spans are: redact, mask, tokenize."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let, piece

REDACTED = "[REDACTED]"
MODES = ("redact", "mask", "tokenize")


def apply_spans(text: Column, spans: Column, replacement: Callable[[Column, Column], Column]) -> Column:
    """text with replacement(original, entity_type) in place of each span; spans are disjoint and in order."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        between = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], between, replacement(piece(text, s), s["entity_type"])).alias("out"))

    done = F.aggregate(spans, zero, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def redact(text: Column, spans: Column) -> Column:
    return apply_spans(text, spans, lambda original, entity: F.lit(REDACTED))


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def mask_value(original: Column, entity: Column) -> Column:
    """What stands for a value of a type when it is masked."""
    n = F.length(original)
    first = F.substr(original, F.lit(1), F.lit(1))
    digits = F.regexp_replace(original, r"(?U)\D", "")
    nd = F.length(digits)
    plain = F.when(n > 1, F.concat(first, _stars(n - 1))).otherwise(REDACTED)
    at = F.instr(original, "@")
    one_at = (F.length(original) - F.length(F.replace(original, F.lit("@"), F.lit(""))) == 1) & (at > 1)
    from_at = F.concat(first, _stars(at - 2), F.substr(original, at))
    last4 = F.concat(_stars(nd - 4), F.right(digits, F.lit(4)))
    return (
        F.when((entity == "EMAIL_ADDRESS") & one_at, from_at)
        .when(entity.isin("IN_PHONE", "PHONE_NUMBER") & (nd >= 4), F.concat(F.left(digits, F.lit(2)), _stars(nd - 4), F.right(digits, F.lit(2))))
        .when(entity == "IN_AADHAAR", F.when(nd >= 4, F.concat(F.lit("XXXX XXXX "), F.right(digits, F.lit(4)))).otherwise("XXXX XXXX XXXX"))
        .when((entity == "IN_PAN") & (n >= 6), F.concat(first, F.lit("****"), F.substr(original, F.lit(6))))
        .when(entity.isin("PERSON", "NAME"), F.concat(first, _stars(n - 1)))
        .when(entity == "IP_ADDRESS", F.concat(F.substring_index(original, ".", 1), F.lit(".***.***.***")))
        .when(entity == "DATE_OF_BIRTH", "** **** 19**")
        .when((entity == "BANK_ACCOUNT") & (n >= 4), F.concat(_stars(n - 4), F.right(original, F.lit(4))))
        .when((entity == "CREDIT_CARD") & (nd >= 4), last4)
        .when((entity == "UPI_ID") & (at > 1), from_at)
        .when(entity.isin("DEVICE_ID", "HASH_VALUE", "IFSC_CODE", "BANK_NAME", "LOCATION"), REDACTED)
        .otherwise(plain)
    )


def mask(text: Column, spans: Column) -> Column:
    return apply_spans(text, spans, mask_value)


def token(entity: Column, key: Column, salt: str) -> Column:
    """A token for all values of a type under one key: 32 hexadecimal digits of SHA-256, grouped 8-4-4-4-12."""
    d = F.sha2(F.concat_ws("\x1f", entity, key.cast("string"), F.lit(salt)), 256)
    parts = [F.substr(d, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<"), F.concat_ws("-", *parts), F.lit(">"))


def tokenize(text: Column, spans: Column, key: Column, salt: str = "") -> Column:
    """Each value becomes the token of its type; one token a type and key, such as the document's id."""
    return apply_spans(text, spans, lambda original, entity: token(entity, key, salt))


def tokenize_random(text: Column, spans: Column) -> Column:
    """As tokenize, with a random token for each type and text; results differ from run to run."""
    types = F.array_distinct(F.transform(spans, lambda s: s["entity_type"]))
    return let(F.struct(types.alias("types"), F.uuid().alias("seed")), lambda x: apply_spans(text, spans, lambda original, entity: token(entity, x["seed"], "")))


def sanitize(text: Column, spans: Column, mode: str, key: Column | None = None, salt: str = "") -> Column:
    """STRUCT<text, n>: the rewritten text and how many spans it had; an unknown mode leaves the text, with 0."""
    if mode not in MODES:
        return F.struct(text.alias("text"), F.lit(0).alias("n"))
    out = redact(text, spans) if mode == "redact" else mask(text, spans) if mode == "mask" else tokenize(text, spans, key, salt) if key is not None else tokenize_random(text, spans)
    return F.struct(out.alias("text"), F.size(spans).alias("n"))
