"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op10_ann
from .decontaminate import OP2_SQL, op2_decontamination
from .langid import op5_language_id
from .lm import op9_lm_scoring
from .packing import op3_packing
from .pages import op4_html_extraction
from .quality import op8_quality_classifier
from .simhash import op1_simhash
from .substrings import OP6_SQL, op6_substring_dedup
from .urls import OP7_SQL, op7_url_filter

OPERATORS = (op1_simhash, op2_decontamination, op3_packing, op4_html_extraction, op5_language_id, op6_substring_dedup, op7_url_filter, op8_quality_classifier, op9_lm_scoring, op10_ann)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op6_substring_dedup": OP6_SQL, "op7_url_filter": OP7_SQL}
