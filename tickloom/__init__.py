"""tickloom: bar-series research on Spark DataFrames.

Every public function takes DataFrames and returns a lazy DataFrame keyed by
``series_id``.  See the README for the data model and the partitioning rules.
"""
