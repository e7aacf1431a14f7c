"""The corpus pipeline (part of the subpackage ``millrace.llm``): its stages and their run, by the names the driver looks for."""

from millrace.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
