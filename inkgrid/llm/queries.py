"""The queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from . import extraction, forest, kneser_ney, minhash, mixing, packing, periodic, pieces, ppm, privacy, quality, substrings, whitening

QUERIES = {
    "op1_ppm_scoring": ppm.op1,
    "op2_bbit_minhash": minhash.op2,
    "op3_prefix_forest": forest.op3,
    "op4_sentencepiece_offsets": pieces.op4,
    "op5_quality_rules": quality.op5,
    "op6_surrogates": privacy.op6,
    "op7_min_cut_extraction": extraction.op7,
    "op8_de_bruijn_spans": substrings.op8,
    "op9_kneser_ney": kneser_ney.op9,
    "op10_config_lp_packing": packing.op10,
    "op11_source_mixing": mixing.op11,
    "op12_repair_runs": periodic.op12,
    "op13_incremental_whitening": whitening.op13,
}

ORACLES = {
    "op5_quality_rules": quality.op5_sql(),
    "op11_source_mixing": mixing.op11_sql(),
}
