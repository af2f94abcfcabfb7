"""All queries and SQL of this subpackage."""

from __future__ import annotations

from . import q_alignment, q_audit, q_chat, q_counts, q_fingerprints, q_jaccard, q_packing, q_pieces, q_quality, q_scoring, q_substrings, q_vectors, q_warc

_MODULES = (q_substrings, q_fingerprints, q_pieces, q_jaccard, q_scoring, q_packing, q_chat, q_quality, q_warc, q_counts, q_alignment, q_vectors, q_audit)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
