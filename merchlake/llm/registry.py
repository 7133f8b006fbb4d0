"""The queries of this package by name, and the SQL of those that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html, language, minhash, mixing, multi_index, packing, secrets, substring, telephony, urls
from .common import findable, table

#: Name of the query: the table that it reads and the function that it applies.
_OPERATORS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "op1_telephony": ("documents", telephony.op1_telephony),
    "op2_mixing": ("documents", mixing.op2_mixing),
    "op3_language": ("documents", language.op3_language),
    "op4_near_duplicates": ("documents", minhash.op4_near_duplicates),
    "op5_packing": ("documents", packing.op5_packing),
    "op6_substrings": ("documents", substring.op6_substrings),
    "op7_embeddings": ("embeddings", multi_index.op7_embeddings),
    "op8_secrets": ("documents", secrets.op8_secrets),
    "op9_html": ("pages", html.op9_html),
    "op10_urls": ("pages", urls.op10_urls),
}


def _query(name: str, apply: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        findable(spark)
        return apply(table(spark, sf_dir, name))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(*v) for k, v in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_telephony": telephony.ORACLE_SQL, "op2_mixing": mixing.ORACLE_SQL, "op4_near_duplicates": minhash.ORACLE_SQL, "op6_substrings": substring.ORACLE_SQL, "op7_embeddings": multi_index.ORACLE_SQL, "op8_secrets": secrets.ORACLE_SQL}
