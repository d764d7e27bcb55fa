"""The training-data pipeline; its stages are in ``brightloom.llm.pipeline``."""

from __future__ import annotations

from brightloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
