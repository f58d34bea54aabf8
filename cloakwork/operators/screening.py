"""Screening of files: rows of (name, content) get a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import threats


def screen(files: DataFrame, name: str = "filename", content: str = "content") -> DataFrame:
    """files with `is_safe` and `reason` (empty if safe).

    All native rules run first; only Office and JSON files that passed them reach Python.  The rows are split by filters,
    since a Python function beside `when` would run for every row.
    """
    wide = files.withColumn("_ext", threats.scan_extension(F.col(name))).withColumn("_reason", threats.native_reason(F.col(name), F.col(content)))
    open_ones = F.col("_reason").isNull()
    office, tree = open_ones & F.col("_ext").isin(".docx", ".xlsx", ".pptx"), open_ones & (F.col("_ext") == ".json")
    done = wide.where(~(office | tree))
    by_zip = wide.where(office).withColumn("_reason", threats.office_scan("_ext", content))
    by_tree = wide.where(tree).withColumn("_reason", threats.json_scan(threats.utf8(F.col(content))))
    every = done.unionByName(by_zip).unionByName(by_tree)
    return every.withColumns({"is_safe": F.col("_reason").isNull(), "reason": F.coalesce("_reason", F.lit(""))}).drop("_ext", "_reason")
