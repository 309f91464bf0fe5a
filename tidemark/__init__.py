"""tidemark: clinical time-series features on Spark.

Cohort chain, dense hourly grid, hourly feature tables and their read side,
all as DataFrame plans.  Entry points:

* ``tidemark.sources.tables.read_inputs`` -- the ten inputs (folders, catalog, JDBC)
* ``tidemark.plans.chain.build_tables`` / ``refresh`` -- the nine tables, lazily or stored
* ``tidemark.operators`` -- the operators one by one
"""

__version__ = "0.1.0"
