"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from . import (best_fit_packing, byte_bpe, chat_formatting, embedding_dedup, fingerprints, line_dedup, ngram_join, quality_resampling, secret_scan,
               spelling_variants, url_filter, warc_bundles, whitening)

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_warc_bundles": warc_bundles.query,
    "op3_embedding_dedup": embedding_dedup.query,
    "op4_byte_bpe": byte_bpe.query,
    "op5_ngram_join": ngram_join.query,
    "op6_fingerprints": fingerprints.query,
    "op7_url_filter": url_filter.query,
    "op8_best_fit_packing": best_fit_packing.query,
    "op9_quality_resampling": quality_resampling.query,
    "op10_line_dedup": line_dedup.query,
    "op11_spelling_variants": spelling_variants.query,
    "op12_embedding_whitening": whitening.query,
    "op13_chat_formatting": chat_formatting.query,
}

SQL = {
    "op1_secret_scan": secret_scan.SQL,
    "op2_warc_bundles": warc_bundles.SQL,
    "op3_embedding_dedup": embedding_dedup.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_spelling_variants": spelling_variants.SQL,
    "op13_chat_formatting": chat_formatting.SQL,
}
