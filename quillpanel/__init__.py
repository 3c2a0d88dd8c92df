"""Spark-native analytics over daily security panels.

Every public function takes and returns DataFrames.  Layers:

* ``functions``  - column expressions (guards, full windows, EMA, similarity of floats)
* ``sources``    - readers, normalisers, the feature store and ledgers
* ``operators``  - features, cross-sections, targets, splits, as-of joins, metrics
* ``plans``      - skew-safe building blocks and the standard assembly of a panel
* ``catalog``    - the registered queries and their reference SQL
"""
