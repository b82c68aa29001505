"""All queries of the core, by name."""

from __future__ import annotations

from strandlake.plans import aggregates, deliveries, exchanges, expressions, files, fits, models, selections, sequences, streams, structures

_PARTS = [deliveries, sequences, aggregates, selections, models, exchanges, fits, expressions, streams, structures, files]

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
