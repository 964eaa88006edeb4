"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, decontaminate, html_text, lines, ngram_lm, packing, pieces, pii, quality, simhash, spelling, substrings, token_counts


def queries() -> dict:
    return {
        "op1_substring_dedup": substrings.op1_substring_dedup,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_html_extraction": html_text.op3_html_extraction,
        "op4_pii": pii.op4_pii,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_simhash": simhash.op6_simhash,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_lm_scores": ngram_lm.op8_lm_scores,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_best_fit_packing": packing.op12_best_fit_packing,
        "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substrings.ORACLE,
        "op2_line_dedup": lines.ORACLE,
        "op7_quality_rules": quality.ORACLE,
        "op8_lm_scores": ngram_lm.ORACLE,
        "op10_decontaminate": decontaminate.ORACLE,
    }
