"""The registered queries of this package and, where SQL can say it, what they must return."""

from __future__ import annotations

from tracklake.llm import fingerprints, html_text, line_dedup, lm_score, ngram_join, packing, quality, secrets, sentence_pieces, sharding

QUERIES = {
    "op1_sentencepiece": sentence_pieces.query,
    "op2_packing": packing.query,
    "op3_html": html_text.query,
    "op4_sharding": sharding.query,
    "op5_quality": quality.query,
    "op6_secrets": secrets.query,
    "op7_ngram_join": ngram_join.query,
    "op8_lm_score": lm_score.query,
    "op9_fingerprints": fingerprints.query,
    "op10_line_dedup": line_dedup.query,
}
ORACLE_SQL: dict[str, str] = {
    "op7_ngram_join": ngram_join.SQL,
    "op10_line_dedup": line_dedup.SQL,
}
