"""Detection and rewriting over DataFrames.

The same semantics as the Columns of `functions`, laid out in projections: what stands below a higher-order function is interpreted, so
conditions and scans get projections of their own, which compile, and only texts that pass a condition reach the interpreted part.  No shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rewrite, spans
from ..functions.rules import Rule
from .geometry import BATCH_CHARS, batches, split_batches


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a small input has fewer partitions than there are; unchanged for others."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    per = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < per * cores else df


def pinned(c: Column) -> Column:
    """c, computed once for each row: the optimizer copies an expression into filters above it, unless it is not deterministic; the condition always holds."""
    return F.when(F.rand(0) + 1 > 0, c)  # plain rand() >= 0 would be folded


def with_candidates(df: DataFrame, text: str = "text", out: str = "found", patterns: list[Rule] | None = None, labels: list[Rule] | None = None) -> DataFrame:
    """df with all spans of patterns and labels of a text column, before clipping and resolving."""
    t = F.col(text)
    wide = df.withColumn("_fold", spans.folded(t)).withColumn("_digit", spans.has_digit(t))
    found = spans.candidates(t, patterns, labels, F.col("_digit"), F.col("_fold"))
    return wide.withColumn(out, pinned(F.when(spans.is_blank(t), spans.no_spans()).otherwise(found))).drop("_fold", "_digit")


def with_spans(df: DataFrame, text: str = "text", out: str = "spans", patterns: list[Rule] | None = None, labels: list[Rule] | None = None) -> DataFrame:
    """df with the disjoint spans of a text column."""
    found = F.col("_found")
    wide = with_candidates(df, text, "_found", patterns, labels)
    return wide.withColumn(out, pinned(F.when(F.size(found) == 0, found).otherwise(spans.resolve(spans.clip_at_newline(found, F.col(text)))))).drop("_found")


def with_routed_spans(df: DataFrame, model: Callable[[Column], Column] | None = None, text: str = "text", out: str = "spans") -> DataFrame:
    """df with spans by length of the text: up to FAST_PATH_CHARS with a model's pass, if there is one, beyond without.

    Rows are split by a filter, not by `when`, so that a model never runs for long texts.
    """
    t = F.col(text)
    short = F.coalesce(F.length(t) <= spans.FAST_PATH_CHARS, F.lit(True))
    fast = with_spans(df.where(~short), text, out)
    wide = df.where(short).withColumn("_fold", spans.folded(t)).withColumn("_digit", spans.has_digit(t))
    none = spans.is_blank(t)
    wide = wide.withColumn("_rules", pinned(F.when(none, spans.no_spans()).otherwise(spans.pattern_scan(t, None, F.col("_digit")))))
    wide = wide.withColumn("_labels", pinned(F.when(none, spans.no_spans()).otherwise(spans.keyword_scan(t, None, fold=F.col("_fold")))))
    wide = wide.withColumn("_model", F.when(none, spans.no_spans()).otherwise(F.coalesce(model(t), spans.no_spans())) if model else spans.no_spans())
    rules, extra = F.col("_rules"), F.col("_model")
    clipped = F.when(F.size(rules) == 0, rules).otherwise(spans.trim_trailing_labels(spans.clip_at_newline(rules, t), t))
    wide = wide.withColumn("_all", pinned(F.concat(clipped, F.col("_labels"), F.when(F.size(extra) == 0, extra).otherwise(spans.clip_at_newline(extra, t)))))
    full = wide.withColumn(out, pinned(F.when(F.size("_all") < 2, F.col("_all")).otherwise(spans.resolve(F.col("_all")))))
    return full.select(*df.columns, out).unionByName(fast)


def sanitize(df: DataFrame, mode: str = "redact", text: str = "text", key: str | None = None, salt: str = "") -> DataFrame:
    """df with `clean`, the rewritten text, and `n_spans`."""
    wide = with_spans(df, text, "_spans")
    done = rewrite.sanitize(F.col(text), F.col("_spans"), mode, F.col(key) if key else None, salt)
    out = {"clean": done["text"], "n_spans": done["n"]}
    return wide.withColumns(out).drop("_spans")


def span_table(df: DataFrame, id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """One row a span: id, entity_type, start, end, score."""
    s = F.col("_s")
    return df.select(F.col(id_col), F.explode(spans_col).alias("_s")).select(id_col, s["entity_type"].alias("entity_type"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["score"].alias("score"))


def sanitize_batches(units: DataFrame, mode: str = "redact", most: int = BATCH_CHARS) -> DataFrame:
    """(file_id, seq, text): units rewritten batch by batch, joined by a separator that no rule matches.

    Gives what `sanitize` gives unit by unit, which is the way to do it; this one exists for passes that need the neighbours of a text.
    """
    joined = batches(units, most).withColumn("_key", F.concat_ws("/", "file_id", "batch"))
    done = sanitize(joined, mode, "text", "_key")
    return split_batches(done.select("file_id", "seqs", F.col("clean").alias("text")))
