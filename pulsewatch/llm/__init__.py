"""Training-data pipeline operators and their queries.

``QUERIES`` maps each query name to ``fn(spark, sf_dir) -> DataFrame`` and
``ORACLES`` holds DuckDB SQL for those whose result SQL can state.  Nothing
outside this package imports it.
"""

from __future__ import annotations

from .queries import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
