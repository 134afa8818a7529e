"""The queries of this subpackage, by name, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, importance, lattice_lm, packing, secret_scan, simhash, suffix_dedup, toxicity, vafile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sum_of_squares_packing": packing.query,
    "op2_canonical_digest": fingerprint.query,
    "op3_weak_supervision_toxicity": toxicity.query,
    "op4_secret_ownership": secret_scan.query,
    "op5_vector_approximation_topk": vafile.query,
    "op6_bpe_rank_array": bpe.query,
    "op7_subword_lattice": lattice_lm.query,
    "op8_simhash_multi_index": simhash.query,
    "op9_suffix_array_dedup": suffix_dedup.query,
    "op10_importance_resampling": importance.query,
}

ORACLE_SQL: dict[str, str] = {"op5_vector_approximation_topk": vafile.ORACLE_SQL}
