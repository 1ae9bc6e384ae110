"""querylab: PySpark-native analytics over tables and over SQL workloads.

Sub-packages
------------
operators  relational, comparison, scoring, catalog/graph and workload operators
sources    readers and writers for corpora, gold/prediction files, catalogs, logs
functions  reusable Column expressions (SQL text features, hardness, tokens)
plans      the registered queries (Spark side + DuckDB oracle SQL)
streaming  Structured Streaming jobs
"""

from querylab.session import get_spark, checkpoint_dir  # noqa: F401
from querylab.tables import Tables  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "Tables"]
