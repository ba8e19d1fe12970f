"""Registered queries and the SQL that must give the same rows."""

from . import content, curation, details, entities, ingest, queries, relational, retrieval, search, streams, text, trends
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "content", "curation", "details", "entities", "ingest", "queries", "relational", "retrieval", "search", "streams", "text", "trends"]
