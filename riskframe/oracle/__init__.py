"""Independent SQL oracles (DuckDB dialect) for the registered queries.

Each string re-derives the fixture views from the driver tables and
computes the operator's result with plain SQL, so the Spark plan is
checked against a second engine on the same parquet files.
"""


