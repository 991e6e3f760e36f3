"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, hard_negatives, html_text, language_id, line_dedup, packing, pii, repeats, simhash, token_counts, variants

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_html_text": html_text.op2_html_text,
    "op3_simhash": simhash.op3_simhash,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_pii": pii.op5_pii,
    "op6_pack_best_fit": packing.op6_pack_best_fit,
    "op7_repeats": repeats.op7_repeats,
    "op8_language_id": language_id.op8_language_id,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_spelling_variants": variants.op13_spelling_variants,
}

ORACLES = {
    "op1_chat_format": chat.SQL,
    "op7_repeats": repeats.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_spelling_variants": variants.SQL,
}
