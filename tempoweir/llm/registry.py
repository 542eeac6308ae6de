"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from tempoweir.llm import embedding_dedup, jaccard_join, license_scan, pfair_mix, pii_surrogates, quality_pu, substring_dedup, template_decontam, url_filter, warc_zip

MODULES = [url_filter, substring_dedup, quality_pu, license_scan, embedding_dedup, jaccard_join, pfair_mix, template_decontam, warc_zip, pii_surrogates]


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    found = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
