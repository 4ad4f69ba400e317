"""The registered queries of this subpackage and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register() -> None:
    from . import (best_fit_packing, decontamination, fill_in_middle, fingerprints, html_extraction, language_id, near_dedup,
                   ngram_join, pii, secret_scan, spelling_variants, toxicity, url_filter)
    for module in (language_id, html_extraction, decontamination, toxicity, best_fit_packing, secret_scan, url_filter, pii,
                   near_dedup, fingerprints, fill_in_middle, ngram_join, spelling_variants):
        QUERIES[module.QUERY] = module.query
        if getattr(module, "SQL", None):
            ORACLE_SQL[module.QUERY] = module.SQL


_register()


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
