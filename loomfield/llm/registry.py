"""The queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from . import bpe_stream, content_sort, language, merkle, mixing, near_dedup, ogg, packing, pii, randomness, runs, suffix_sort, superkmers

QUERIES = {
    "op1_substring_dedup": superkmers.op1_substring_dedup,
    "op2_language_id": language.op2_language_id,
    "op3_media_columns": ogg.op3_media_columns,
    "op4_suffix_array_dedup": suffix_sort.op4_suffix_array_dedup,
    "op5_pii": pii.op5_pii,
    "op6_secret_scans": randomness.op6_secret_scans,
    "op7_mixing_sources": mixing.op7_mixing_sources,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_exact_dedup": content_sort.op9_exact_dedup,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_bpe_coding": bpe_stream.op13_bpe_coding,
}

ORACLES = {
    "op7_mixing_sources": mixing.ORACLE_SQL,
    "op1_substring_dedup": superkmers.ORACLE_SQL,
    "op9_exact_dedup": content_sort.ORACLE_SQL,
    "op10_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_periodic_runs": runs.ORACLE_SQL,
}
