"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, scratch_path
from . import (decontaminate, fingerprints, html_text, license_scan, line_chunks, packing, periodic_runs, ranked_search,
               sharding, simhash, suffix_dedup, toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@register("op1_packing")
def _packing(spark, d):
    return packing.pack(load(spark, d, "documents"), tokenizer_path(), keep_ids=False)


@register("op2_sharding")
def _sharding(spark, d):
    return sharding.shard(load(spark, d, "documents"))


@register("op3_html_extraction")
def _html_extraction(spark, d):
    return html_text.extract(load(spark, d, "pages"))


@register("op4_warc")
def _warc(spark, d):
    path = scratch_path(spark, "archives")
    warc.write_archives(load(spark, d, "pages"), path)
    return warc.page_digests(spark, path)


@register("op6_simhash")
def _simhash(spark, d):
    return simhash.near_duplicates(load(spark, d, "documents"))


@register("op7_line_dedup", line_chunks.SQL)
def _line_dedup(spark, d):
    return line_chunks.deduplicate(load(spark, d, "documents")).select(
        "doc_id", "text", F.col("_chunk_lines").alias("n_lines"),
        F.col("_chunk_removed_lines").alias("n_removed_lines"), F.col("_chunk_removed").alias("n_removed_chunks"))


@register("op10_decontamination")
def _decontamination(spark, d):
    return decontaminate.contaminated(load(spark, d, "documents"), load(spark, d, "benchmark")).drop("digest")


@register("op5_toxicity")
def _toxicity(spark, d):
    return toxicity.scores(load(spark, d, "documents"), load(spark, d, "labels"))


@register("op9_suffix_dedup")
def _suffix_dedup(spark, d):
    return suffix_dedup.deduplicate(load(spark, d, "documents"), keep_text=True)


@register("op8_fingerprints")
def _fingerprints(spark, d):
    return fingerprints.with_edits(load(spark, d, "documents"))


@register("op11_periodic_runs")
def _periodic_runs(spark, d):
    return periodic_runs.digests(load(spark, d, "documents"))


@register("op12_license_scan", license_scan.SQL)
def _license_scan(spark, d):
    return license_scan.labelled(load(spark, d, "documents"))


@register("op13_ranked_search", ranked_search.SQL)
def _ranked_search(spark, d):
    return ranked_search.search(load(spark, d, "documents"), load(spark, d, "benchmark"))
