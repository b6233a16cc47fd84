"""Name -> query and name -> oracle SQL for the operators of the lexical-graph engine."""

from . import build_queries, graph_queries, lexicon_queries, qa_queries
from .catalog import ORACLES, QUERIES

FLAGSHIP = "neighbourhood_lookup"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "build_queries", "graph_queries", "lexicon_queries", "qa_queries"]
