"""The corpus pipeline: five stages over ``documents``; see ``pagemill.llm.stages``."""

from __future__ import annotations

from pagemill.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
