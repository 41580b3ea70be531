"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .arrowfiles import op8_arrow_token_files
from .centroids import ORACLE_SQL as CENTROIDS_SQL
from .centroids import op13_annulus_clusters
from .decontaminate import op1_benchmark_decontamination
from .infill import ORACLE_SQL as INFILL_SQL
from .infill import op12_chunked_infill
from .jaccard import ORACLE_SQL as JACCARD_SQL
from .jaccard import op7_ngram_jaccard_join
from .licences import op6_license_scan
from .packing import op9_mixture_packing
from .pii import op5_feistel_pseudonyms
from .quality import ORACLE_SQL as QUALITY_SQL
from .quality import op2_quality_rules
from .secrets import op3_secret_scan
from .sharding import op4_hash_ring_shards
from .substrings import ORACLE_SQL as SUBSTRINGS_SQL
from .substrings import op10_recompression_dedup
from .suffixes import ORACLE_SQL as SUFFIXES_SQL
from .suffixes import op11_induced_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_scan": op3_secret_scan,
    "op4_hash_ring_shards": op4_hash_ring_shards,
    "op5_feistel_pseudonyms": op5_feistel_pseudonyms,
    "op6_license_scan": op6_license_scan,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_arrow_token_files": op8_arrow_token_files,
    "op9_mixture_packing": op9_mixture_packing,
    "op10_recompression_dedup": op10_recompression_dedup,
    "op11_induced_suffix_dedup": op11_induced_suffix_dedup,
    "op12_chunked_infill": op12_chunked_infill,
    "op13_annulus_clusters": op13_annulus_clusters,
}

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": QUALITY_SQL, "op7_ngram_jaccard_join": JACCARD_SQL, "op10_recompression_dedup": SUBSTRINGS_SQL, "op11_induced_suffix_dedup": SUFFIXES_SQL, "op12_chunked_infill": INFILL_SQL, "op13_annulus_clusters": CENTROIDS_SQL}
