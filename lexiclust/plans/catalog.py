"""Registered queries: each key maps to a Spark plan over the given tables and,
where the operator has a SQL form, the DuckDB oracle computing the same rows.

Column names and integer widths are the same on both sides; doubles are
rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from ..functions import text as tx
from ..operators import corpus as co
from ..operators import stats as st
from . import sqlgen as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


# --------------------------------------------------------------------------
# P0: clean -> sentences -> tokens -> frequencies

@register("scan_lines", f"""
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT doc_id, {q.posexplode("string_split(text, chr(10))", "line", "line_no")} FROM documents)
WHERE trim(line) <> ''
""")
def _scan_lines(spark, d):
    return co.scan_lines(load(spark, d, "documents"))


@register("strip_symbols", f"""
SELECT doc_id, {q.strip_symbols('text')} AS text FROM documents
""")
def _strip_symbols(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.strip_symbols("text").alias("text"))


@register("split_sentences", f"""
SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, sentence FROM (
  SELECT doc_id, {q.posexplode(q.sentence_array(q.decontract('text')), 'sentence', 'sent_no')} FROM documents)
""")
def _split_sentences(spark, d):
    return co.split_sentences(load(spark, d, "documents"))


TOKENS_SQL = f"""
SELECT doc_id, unnest({q.clean_tokens('text')}) AS token FROM documents
"""


@register("token_freq", f"""
SELECT token, count(*) AS cnt FROM ({TOKENS_SQL}) GROUP BY token
""")
def _token_freq(spark, d):
    return st.token_freq(co.tokens(load(spark, d, "documents")))


@register("most_common", f"""
SELECT token, count(*) AS cnt FROM ({TOKENS_SQL}) GROUP BY token
ORDER BY cnt DESC, token LIMIT 100
""")
def _most_common(spark, d):
    return st.most_common(st.token_freq(co.tokens(load(spark, d, "documents"))), 100)


PLAN_MODULES = ["catalog_text", "catalog_prep", "catalog_cluster", "catalog_compare", "catalog_ngrams", "catalog_learn", "catalog_sim", "catalog_io", "catalog_models", "catalog_misc",
                "catalog_search"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import importlib
    for m in PLAN_MODULES:  # each module registers its queries on import
        importlib.import_module(f"{__package__}.{m}")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)
