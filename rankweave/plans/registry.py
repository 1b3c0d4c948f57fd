"""Every query of the engine's operator families, with its SQL oracle."""

from __future__ import annotations

from . import boost_queries, candidate_queries, curation_queries, file_queries, learned_queries, pool_queries, predict_queries, ranking_queries, rename_queries, retrieval_queries, rewrite_queries, stream_queries, text_queries, view_queries  # noqa: F401  they register their queries
from .base import ORACLE_SQL, QUERIES

FLAGSHIP = retrieval_queries.lexical_evaluation
