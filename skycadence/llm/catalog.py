"""The queries of this package, and the SQL that states the results SQL can express."""

from __future__ import annotations

from skycadence.llm import (
    collocations,
    decontamination,
    exact_dedup,
    html_tree,
    language_id,
    line_templates,
    mixing,
    quality,
    secret_links,
    setsketch,
    suffix_family,
    toxicity,
    whitening,
)

QUERIES = {
    "op1_template_line_dedup": line_templates.op1_template_line_dedup,
    "op2_setsketch_near_dedup": setsketch.op2_setsketch_near_dedup,
    "op3_poisson_mixing": mixing.op3_poisson_mixing,
    "op4_cnn_toxicity": toxicity.op4_cnn_toxicity,
    "op5_cgk_decontamination": decontamination.op5_cgk_decontamination,
    "op6_bitmask_language_id": language_id.op6_bitmask_language_id,
    "op7_rule_quality": quality.op7_rule_quality,
    "op8_suffix_family_dedup": suffix_family.op8_suffix_family_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_dom_marginals": html_tree.op10_dom_marginals,
    "op11_credential_links": secret_links.op11_credential_links,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
SQL = {
    "op2_setsketch_near_dedup": setsketch.SQL,
    "op3_poisson_mixing": mixing.SQL,
    "op8_suffix_family_dedup": suffix_family.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_credential_links": secret_links.SQL,
    "op12_phrase_collocations": collocations.SQL,
}
