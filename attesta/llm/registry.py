"""The queries of this subpackage and their SQL, by the names they are registered under."""

from __future__ import annotations

from . import collocations, exact_dedup, importance, language, line_resampling, media, mixing, near_dedup, packing, pieces, secrets, surrogates, toxicity

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_pii_surrogates": surrogates.query,
    "op3_media_columns": media.query,
    "op4_pack_windows": packing.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_importance_resampling": importance.query,
    "op7_language_id": language.query,
    "op8_toxicity": toxicity.query,
    "op9_mix_sources": mixing.query,
    "op10_near_duplicates": near_dedup.query,
    "op11_sentencepiece": pieces.query,
    "op12_target_resampling": line_resampling.query,
    "op13_collocations": collocations.query,
}

SQL = {
    "op5_exact_dedup": exact_dedup.SQL,
    "op9_mix_sources": mixing.SQL,
    "op12_target_resampling": line_resampling.SQL,
    "op13_collocations": collocations.SQL,
}
