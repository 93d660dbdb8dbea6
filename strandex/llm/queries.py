"""The subpackage's queries and, where SQL can express one, its DuckDB statement."""

from __future__ import annotations

from strandex.llm import bpe, collocations, embeddings, filter_audit, fingerprints, language_model, lines, mixing, preference, quality, shingles, token_files, urls

QUERIES = {
    "op1_preference_format": preference.op1_preference_format,
    "op2_cross_entropy_difference": language_model.op2_cross_entropy_difference,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_ngram_jaccard_join": shingles.op6_ngram_jaccard_join,
    "op7_token_files": token_files.op7_token_files,
    "op8_embedding_near_dedup": embeddings.op8_embedding_near_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_url_filter": urls.op10_url_filter,
    "op11_collocations": collocations.op11_collocations,
    "quality_base_columns": quality.quality_base_columns,
    "url_rules": urls.url_rules,
    "op12_document_fingerprints": fingerprints.op12_document_fingerprints,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op1_preference_format": preference.SQL,
    "op8_embedding_near_dedup": embeddings.SQL,
    "op11_collocations": collocations.SQL,
    "quality_base_columns": quality.SQL,
    "url_rules": urls.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
