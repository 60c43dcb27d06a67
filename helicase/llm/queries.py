"""Queries of this subpackage, each an operator over its whole table, and the SQL of those that SQL can express."""

from helicase.llm import decontaminate, html_text, mixing, ngram_join, phrase_dedup, pii, quality, token_counts, url_filter, warc

QUERIES = {
    "op7_html_text": html_text.op7_html_text,
    "op5_url_filter": url_filter.op5_url_filter,
    "op8_warc_revisits": warc.op8_warc_revisits,
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op6_phrase_dedup": phrase_dedup.op6_phrase_dedup,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op2_ngram_jaccard_links": ngram_join.op2_ngram_jaccard_links,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_quality_rules": quality.op10_quality_rules,
}

ORACLE_SQL = {
    "op8_warc_revisits": warc.OP8_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_phrase_dedup": phrase_dedup.OP6_SQL,
    "op2_ngram_jaccard": ngram_join.OP2_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op10_quality_rules": quality.OP10_SQL,
}
