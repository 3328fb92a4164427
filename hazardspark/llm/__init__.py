"""Operators for preparing training data, on Spark DataFrames.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""
