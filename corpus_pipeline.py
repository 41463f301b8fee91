"""The corpus pipeline: STAGES over `documents`, run() and its SQL (none). The stages are in skyfold.llm.pipeline."""

from skyfold.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
