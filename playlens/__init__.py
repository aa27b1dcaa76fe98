"""playlens: gameplay telemetry cleaning and level analytics on Spark.

Layers:

* ``sources``   - readers for raw event tables (parquet/csv) and the test fixture
* ``functions`` - reusable Column expressions (repairs, ratios, rounding)
* ``operators`` - DataFrame -> DataFrame transforms (repair, dedup, identity,
                  attribute cascade, level timeline, outcome medians)
* ``plans``     - compositions: the cleaning pipeline, EDA, drop-off,
                  difficulty, output tables and dashboard datasets
* ``streaming`` - incremental ingestion of raw events into the typed table
* ``oracle``    - DuckDB SQL used only to check results
"""

from playlens.model import ALL14, RAW_COLUMNS  # noqa: F401

__all__ = ["ALL14", "RAW_COLUMNS"]
