"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundspark.llm.divergence import ORACLE as DIVERGENCE_ORACLE
from groundspark.llm.divergence import op11_source_divergence
from groundspark.llm.extraction import op12_html_extraction
from groundspark.llm.jaccard import op1_ngram_jaccard
from groundspark.llm.neighbours import op4_nearest
from groundspark.llm.packing import op5_packing
from groundspark.llm.passages import op10_suffix_dedup
from groundspark.llm.pieces import op2_sentencepiece
from groundspark.llm.quality import ORACLE as QUALITY_ORACLE
from groundspark.llm.quality import op9_quality_rules
from groundspark.llm.sharding import op7_sharding
from groundspark.llm.tokenfile import op8_token_ids
from groundspark.llm.toxicity import op3_toxicity
from groundspark.llm.urls import op6_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_nearest": op4_nearest,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_sharding": op7_sharding,
    "op8_token_ids": op8_token_ids,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_html_extraction": op12_html_extraction,
}
ORACLE_SQL: dict[str, str] = {
    "op9_quality_rules": QUALITY_ORACLE,
    "op11_source_divergence": DIVERGENCE_ORACLE,
}
