"""Queries and SQL of the subpackage's operators."""

from __future__ import annotations

from pelorus.llm import exact_dedup, fingerprints, html_extract, language_id, linear_grouping, packing, periodic_runs, piece_lattice, secret_scan, sessions, simhash, substring_dedup, token_counts

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_simhash": simhash.op8_simhash,
    "op9_piece_nbest": piece_lattice.op9_piece_nbest,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_gap_sessions": sessions.op11_gap_sessions,
    "op12_fewest_sequences": linear_grouping.op12_fewest_sequences,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op11_gap_sessions": sessions.OP11_SQL,
}
