"""All queries of the engine and their oracles."""

from __future__ import annotations

from . import analysis_queries, entity_queries, interface_queries, language_queries, parse_queries, phono_queries, sentence_queries, text_queries

GROUPS = (text_queries, parse_queries, analysis_queries, phono_queries, interface_queries, entity_queries, sentence_queries, language_queries)
QUERIES = {name: f for group in GROUPS for name, f in group.QUERIES.items()}
ORACLES = {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}
