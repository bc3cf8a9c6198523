"""All queries of the library by name, and the SQL text that gives the same rows."""

from __future__ import annotations

from quillon.plans import audits, bank, corpus, decisions, learner, linking, matching, papers, projections, streams, transcripts, validation, versions
from quillon.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audits", "bank", "corpus", "decisions", "learner", "linking", "matching", "papers", "projections", "streams", "transcripts", "validation", "versions"]
