"""The corpus pipeline, where the driver looks for it: five stages over documents, kept with the text operators."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
