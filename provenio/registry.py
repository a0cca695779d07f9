"""The registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from provenio.queries import comparing, evidence, further, parsing, policies, ranking, reading, storing
from provenio.queries.base import ORACLE_SQL, QUERIES

MODULES = (reading, parsing, evidence, ranking, comparing, further, storing, policies)
FLAGSHIP = "locate_quote"

__all__ = ["FLAGSHIP", "MODULES", "ORACLE_SQL", "QUERIES"]
