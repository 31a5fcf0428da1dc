"""The corpus pipeline: ``run(spark, sf_dir)`` applies STAGES, in order, to the table ``documents``."""

from __future__ import annotations

from quirelake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
