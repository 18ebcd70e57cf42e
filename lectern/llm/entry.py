"""What the driver's entry file adds: one query for each operator, and the pipeline."""

import corpus_pipeline
from lectern.llm.queries import ORACLE, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLE", "QUERIES"]
