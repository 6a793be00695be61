"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import cuckoo_dedup, license_scan, line_dedup, mixing, ngram_join, ordinal_quality, packing, perplexity_rules, secret_scan, sharding


def queries():
    found = [
        secret_scan.op1_secret_scan,
        mixing.op2_pfair_mixing,
        line_dedup.op3_fuzzy_line_dedup,
        license_scan.op4_license_scan,
        cuckoo_dedup.op5_cuckoo_exact_dedup,
        perplexity_rules.op6_perplexity_rules,
        ordinal_quality.op7_ordinal_quality,
        sharding.op8_permutation_sharding,
        packing.op9_best_fit_packing,
        ngram_join.op10_ngram_jaccard_join,
    ]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op5_cuckoo_exact_dedup": cuckoo_dedup.ORACLE_SQL, "op10_ngram_jaccard_join": ngram_join.ORACLE_SQL}
