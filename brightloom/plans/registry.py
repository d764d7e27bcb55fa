"""All queries of the evaluation-study operators, with their DuckDB SQL."""

from __future__ import annotations

from brightloom.plans import assurance, records, statistics, text

QUERIES = {**statistics.QUERIES, **text.QUERIES, **records.QUERIES, **assurance.QUERIES}
ORACLES = {**statistics.ORACLES, **text.ORACLES, **records.ORACLES, **assurance.ORACLES}
