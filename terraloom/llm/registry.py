"""The queries and SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["html_text", "token_counts", "ngram_join", "private_data", "warc_chunks", "packing", "quality_rules", "fingerprints", "line_dedup", "sentence_pieces", "embedding_links", "periodic_runs", "lexical_search"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
