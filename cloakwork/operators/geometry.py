"""Recognised lines of images, tokens of models, and batches of texts: the algebra around detection.

ocr_line(doc_id, line_idx, box ARRAY<ARRAY<DOUBLE>>, text, confidence) · token(doc_id, idx, label, start, end)
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spans import let

# Fixed values.
MIN_CONFIDENCE = 0.5
SEPARATOR = "\n\x00\n"
BATCH_CHARS = 50_000
WINDOW_CHARS = 3500
WINDOW_STRIDE = 2800
MODEL_SCORE = 0.9
LABEL_TYPES = {"NAME_STUDENT": "PERSON", "EMAIL": "EMAIL_ADDRESS", "PHONE_NUM": "IN_PHONE", "STREET_ADDRESS": "LOCATION", "ID_NUM": "ID_NUM", "URL_PERSONAL": "URL", "USERNAME": "USERNAME"}
OCR_DEFAULTS = {
    "use_gpu": False, "lang": "en", "det_db_threshold": 0.3, "rec_confidence_threshold": 0.5, "max_image_long_side": 960, "dpi": 300, "batch_size": 1, "use_structure": False, "concurrency": 4, "model": {"use_angle_cls": True},
    "preprocessing": {"deskew": False, "denoise": False, "sharpen": False, "contrast_enhance": False, "binarization": None, "auto_crop_text_regions": False, "dpi_convert": 300},
    "postprocessing": {"spellcheck": False, "language_model_correction": False, "confidence_threshold": 0.5}, "output_formats": ["txt", "json"], "save_path": "./ocr_outputs",
}


def ocr_config(given: dict | None = None) -> dict:
    """Settings with defaults filled in, in the top level and one below."""
    given = given or {}
    out = {k: ({**v, **given[k]} if isinstance(v, dict) and isinstance(given.get(k), dict) else given.get(k, v)) for k, v in OCR_DEFAULTS.items()}
    return out | {k: v for k, v in given.items() if k not in out}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def confident(lines: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    return lines.where(F.col("confidence") >= least)


def rstrip_lines(text: Column) -> Column:
    """Each line without the blanks at its end."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def postprocess(text: Column) -> Column:
    """Compatibility forms become plain ones, and lines lose the blanks at their ends."""
    return rstrip_lines(nfkc(text))


def line_text(lines: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, text: the confident lines of each document, one a line."""
    ordered = F.array_sort(F.collect_list(F.struct("line_idx", "text")))
    return confident(lines, least).groupBy("doc_id").agg(rstrip_lines(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")).alias("text"))


def box_rect(box: Column) -> Column:
    """STRUCT<x, y, w, h> around a quadrilateral, at least 1 by 1."""
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    x, y = F.array_min(xs).cast("int"), F.array_min(ys).cast("int")
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(1), F.array_max(xs).cast("int") - x).alias("w"), F.greatest(F.lit(1), F.array_max(ys).cast("int") - y).alias("h"))


def line_offsets(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, stripped, with their place [char_start, char_end) in the document's text, where one space parts them."""
    kept = lines.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")
    before = W.partitionBy("doc_id").orderBy("line_idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return kept.withColumn("char_start", start.cast("long")).withColumn("char_end", F.col("char_start") + F.length("text"))


def overlapping(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Each span (doc_id, entity_type, start, end) with each line of its document that it overlaps.

    The join is on the document; a document's lines and spans are few, and the overlap is a condition of the same join.
    """
    places = lines.select("doc_id", "line_idx", "char_start", "char_end", F.col("text").alias("line_text"), "box")
    return spans.join(places, "doc_id").where((F.col("char_start") < F.col("end")) & (F.col("char_end") > F.col("start")))


def sub_boxes(pairs: DataFrame) -> DataFrame:
    """The part of a line's box that a span covers, by its share of the characters; boxes under 2 by 2 are left out."""
    wide = pairs.withColumn("_r", box_rect(F.col("box"))).where("_r.w >= 2 and _r.h >= 2")
    a = F.greatest("start", "char_start") - F.col("char_start")
    b = F.least("end", "char_end") - F.col("char_start")
    n = F.length("line_text")
    x = (F.col("_r.x") + F.when(n > 0, a / n).otherwise(0.0) * F.col("_r.w")).cast("int")
    w = F.greatest((F.when(n > 0, b / n - a / n).otherwise(1.0) * F.col("_r.w")).cast("int"), F.lit(2))
    return wide.select("doc_id", "line_idx", "entity_type", x.cast("long").alias("x"), F.col("_r.y").cast("long").alias("y"), w.cast("long").alias("w"), F.col("_r.h").cast("long").alias("h"), F.substr("line_text", (a + 1).cast("int"), (b - a).cast("int")).alias("part"))


def median_colours(pixels: DataFrame) -> DataFrame:
    """doc_id, r, g, b: whole parts of the medians of a pixel table's channels."""
    return pixels.groupBy("doc_id").agg(*[F.percentile(c, F.lit(0.5)).cast("long").alias(c) for c in ("r", "g", "b")])


def label_type(label: Column) -> Column:
    """The type of a B- or I- label; null for others."""
    known = F.create_map(*[F.lit(x) for pair in LABEL_TYPES.items() for x in pair])
    raw = F.replace(F.substr(label, F.lit(3)), F.lit("_STUDENT"), F.lit(""))
    return F.when(label.startswith("B-") | label.startswith("I-"), F.coalesce(F.try_element_at(known, raw), raw))


def bio_spans(tokens: DataFrame) -> DataFrame:
    """doc_id, entity_type, start, end: runs of tokens of one type.  A token without a type, or empty at 0, ends a run.

    Islands: a run's number is the count of changes up to its tokens.
    """
    order = W.partitionBy("doc_id").orderBy("idx")
    kind = F.when((F.col("start") == 0) & (F.col("end") == 0), None).otherwise(label_type(F.col("label")))
    wide = tokens.withColumn("entity_type", kind).withColumn("_new", (~F.col("entity_type").eqNullSafe(F.lag("entity_type").over(order))).cast("int"))
    wide = wide.withColumn("_run", F.sum("_new").over(order)).where("entity_type is not null")
    runs = wide.groupBy("doc_id", "_run", "entity_type").agg(F.min(F.struct("idx", "start"))["start"].alias("start"), F.max(F.struct("idx", "end"))["end"].alias("end"))
    return runs.select("doc_id", "entity_type", "start", "end")


def merge_neighbours(spans: DataFrame, gap: int = 1) -> DataFrame:
    """Spans of one type that follow each other at most `gap` characters apart become one."""
    order = W.partitionBy("doc_id").orderBy("start", "end")
    joins = (F.lag("entity_type").over(order) == F.col("entity_type")) & (F.col("start") - F.lag("end").over(order) <= gap)
    wide = spans.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    return wide.groupBy("doc_id", "_run", "entity_type").agg(F.min("start").alias("start"), F.max(F.struct("start", "end"))["end"].alias("end")).drop("_run")


def windows(text: Column, size: int = WINDOW_CHARS, stride: int = WINDOW_STRIDE) -> Column:
    """ARRAY<STRUCT<start, end>>: overlapping windows of a text; one that isn't the last ends after a space, if there is one beyond the stride.

    Windows end with the one that reaches the end of the text.
    """
    n = F.length(text)
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, _: Column) -> Column:
        def window(stop: Column) -> Column:
            tail = F.substr(text, acc["at"] + stride + 1, stop - acc["at"] - stride)
            last = F.length(tail) - F.length(F.substring_index(tail, " ", -1))  # characters up to the last space, with it
            end = F.when((stop < n) & (last > 0), acc["at"] + stride + last).otherwise(stop)
            out = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))
            return F.struct(F.when(end >= n, n).otherwise(F.greatest(acc["at"] + 1, end - (size - stride))).cast("int").alias("at"), out.alias("out"))

        return F.when(acc["at"] >= n, acc).otherwise(let(F.least(acc["at"] + size, n), window))

    most = F.sequence(F.lit(0), F.floor(n / (stride - (size - stride))).cast("int") + 1)
    return F.aggregate(most, zero, step, lambda acc: acc["out"])


def greedy_batches(lengths: Column, most: int = BATCH_CHARS, gap: int = len(SEPARATOR)) -> Column:
    """The batch number of each text of a list of lengths: a new batch begins where the next text would exceed `most`."""
    zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, n: Column) -> Column:
        fits = (acc["size"] == 0) | (acc["size"] + n + gap <= most)
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        return F.struct(F.when(fits, acc["size"] + n + gap).otherwise(n + gap).cast("int").alias("size"), batch.cast("int").alias("batch"), F.concat(acc["out"], F.array(batch.cast("int"))).alias("out"))

    return F.aggregate(F.transform(lengths, lambda x: x.cast("int")), zero, add, lambda acc: acc["out"])


def batches(units: DataFrame, most: int = BATCH_CHARS) -> DataFrame:
    """file_id, batch, text, seqs: a file's texts that are not blank, joined by the separator, batch by batch.  A file's units are a group."""
    good = units.where(F.col("text").rlike(r"(?U)\S"))
    lists = good.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("u"))
    numbered = lists.withColumn("b", greedy_batches(F.transform("u", lambda x: F.length(x["text"])), most))
    rows = numbered.select("file_id", F.explode(F.arrays_zip("u", "b")).alias("x")).select("file_id", F.col("x.b").alias("batch"), F.col("x.u").alias("u"))
    ordered = F.array_sort(F.collect_list("u"))
    return rows.groupBy("file_id", "batch").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), SEPARATOR).alias("text"), F.transform(ordered, lambda x: x["seq"]).alias("seqs"))


def split_batches(done: DataFrame) -> DataFrame:
    """file_id, seq, text: a batch's text parted again."""
    parts = F.arrays_zip(F.col("seqs").alias("seq"), F.split("text", SEPARATOR, -1).alias("text"))
    return done.select("file_id", F.explode(parts).alias("x")).select("file_id", F.col("x.seq").alias("seq"), F.col("x.text").alias("text"))
