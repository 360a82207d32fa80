"""tidewater — Spark-native pipeline-metadata analytics and declarative dataset runs.

Subpackages
-----------
sources    readers, test-bed corpora rendered from the driver tables, sinks
functions  column-expression helpers (pure ``pyspark.sql.functions``)
operators  DataFrame -> DataFrame building blocks grouped by subject
plans      the query catalog (``queries()``) and its DuckDB oracle SQL
streaming  Structured Streaming jobs reusing the batch operators
"""

__version__ = "0.1.0"
