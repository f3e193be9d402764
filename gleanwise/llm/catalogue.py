"""The queries of this folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import binary_ids, bpe, collocations, edit_counts, exact_dedup, filter_audit, html_extract, large_items, ngram_join, packing, quality, sharding, url_filter

QUERIES = {
    "op1_url_filters": url_filter.query,
    "op2_html_extraction": html_extract.query,
    "op3_kd_sharding": sharding.query,
    "op4_bpe_tree": bpe.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_packing": packing.query,
    "op7_edit_counts": edit_counts.query,
    "op8_binary_ids": binary_ids.query,
    "op9_ngram_join": ngram_join.query,
    "op10_quality_rules": quality.query,
    "op11_large_items": large_items.query,
    "op12_filter_audit": filter_audit.query,
    "op13_collocations": collocations.query,
}

SQL = {
    "op1_url_filters": url_filter.SQL,
    "op2_html_extraction": html_extract.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op9_ngram_join": ngram_join.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_collocations": collocations.SQL,
}
