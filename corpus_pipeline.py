"""The corpus pipeline's contract: its stages, their SQL and the run over documents (see tidemark/llm/pipeline.py)."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
