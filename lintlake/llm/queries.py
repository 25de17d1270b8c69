"""The queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import ann, bbit_minhash, bpe, filter_audit, jaccard_join, katz, langid, mixing, quality, resampling, secrets, substring_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_language_id": langid.op2_language_id,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_quality_perplexity": quality.op4_quality_perplexity,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_nearest_neighbours": ann.op6_nearest_neighbours,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_katz_scores": katz.op9_katz_scores,
    "op10_bpe_encode_decode": bpe.op10_bpe_encode_decode,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_bbit_minhash": bbit_minhash.op13_bbit_minhash,
}

#: The other operators learn, merge or search, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op8_secret_scan": secrets.ORACLE_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL, "op12_importance_resampling": resampling.ORACLE_SQL, "op13_bbit_minhash": bbit_minhash.ORACLE_SQL}
