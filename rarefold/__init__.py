"""rarefold: Spark-native analytics for labelled tables with a rare positive class.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from the
DataFrame / SQL API; nothing pulls a table through the driver.  Sub-packages:

* ``sources``   scans, bindings of the driver tables, sinks (CSV, parquet, JSON)
* ``functions`` column-expression helpers and the two-level prefix-sum kernel
* ``operators`` contract, profile, audit, features, folds, metrics, models, ...
* ``plans``     the registered queries and their DuckDB oracle SQL
* ``streaming`` the row-wise contract on a streaming DataFrame
"""

__version__ = "0.1.0"
