"""The registered queries of the training-data operators and the SQL that DuckDB can hold them to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.binary_output import op1_token_output
from lumenfold.llm.byte_bpe import op7_byte_bpe
from lumenfold.llm.centroids import op12_centroid_clusters
from lumenfold.llm.license_scan import op3_license_scan
from lumenfold.llm.lm_score import op5_lm_score
from lumenfold.llm.merkle import op13_merkle_manifest
from lumenfold.llm.metric_join import op8_embedding_dedup
from lumenfold.llm.ngram_join import op2_ngram_join
from lumenfold.llm.oracles import ORACLE_SQL
from lumenfold.llm.packing import op10_packing
from lumenfold.llm.quality_rules import op9_quality_rules
from lumenfold.llm.sharding import op11_label_sharding
from lumenfold.llm.substring_dedup import op6_substring_dedup
from lumenfold.llm.suffix_dedup import op4_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_output, op2_ngram_join, op3_license_scan, op4_suffix_dedup, op5_lm_score, op6_substring_dedup, op7_byte_bpe, op8_embedding_dedup, op9_quality_rules, op10_packing, op11_label_sharding, op12_centroid_clusters, op13_merkle_manifest)
}

__all__ = ["ORACLE_SQL", "QUERIES"]
