"""The queries of this subpackage and their SQL."""

from kgflow.llm import op01_bpe, op02_html_extraction, op03_pivot_dedup, op04_mixing, op05_ngram_jaccard, op06_token_counts, op07_line_dedup, op08_quality_gam, op09_url_filters, op10_exact_dedup, op11_orchard, op12_secret_novelty, op13_cross_align

QUERIES = {
    "op1_bpe": op01_bpe.query,
    "op2_html_extraction": op02_html_extraction.query,
    "op3_pivot_dedup": op03_pivot_dedup.query,
    "op4_mixing": op04_mixing.query,
    "op5_ngram_jaccard": op05_ngram_jaccard.query,
    "op6_token_counts": op06_token_counts.query,
    "op7_line_dedup": op07_line_dedup.query,
    "op8_quality_gam": op08_quality_gam.query,
    "op9_url_filters": op09_url_filters.query,
    "op10_exact_dedup": op10_exact_dedup.query,
    "op11_orchard": op11_orchard.query,
    "op12_secret_novelty": op12_secret_novelty.query,
    "op13_cross_align": op13_cross_align.query,
}
SQL = {
    "op4_mixing": op04_mixing.SQL,
    "op9_url_filters": op09_url_filters.SQL,
    "op10_exact_dedup": op10_exact_dedup.SQL,
    "op11_orchard": op11_orchard.SQL,
}
