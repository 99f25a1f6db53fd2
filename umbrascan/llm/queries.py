"""The registered queries of the thirteen operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontam, langid, licenses, line_dedup, packing, periodic, simhash_dedup, spelling, token_files, toxicity, webp

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_packing": packing.op3_packing,
    "op4_language_id": langid.op4_language_id,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_simhash_near_dedup": simhash_dedup.op7_simhash_near_dedup,
    "op8_benchmark_decontamination": decontam.op8_benchmark_decontamination,
    "op9_token_files": token_files.op9_token_files,
    "op10_webp_media": webp.op10_webp_media,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_bpe": bpe.op12_bpe,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

SQL = {"op6_chat_formatting": chat.SQL, "op8_benchmark_decontamination": decontam.SQL, "op13_spelling_variants": spelling.SQL}
