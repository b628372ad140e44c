"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, collocations, decontamination, licenses, packing, quality_classifier, quality_rules, scoring, simhash, spelling, token_counts, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_lm_scores": scoring.op1_lm_scores,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_chat_tree": chat.op4_chat_tree,
        "op5_simhash": simhash.op5_simhash,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_host_quality": quality_rules.op7_host_quality,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_collocations": collocations.op11_collocations,
        "op12_quality_classifier": quality_classifier.op12_quality_classifier,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_tree": chat.OP4_SQL, "op7_host_quality": quality_rules.OP7_SQL, "op9_url_filter": url_filter.OP9_SQL, "op11_collocations": collocations.OP11_SQL}
