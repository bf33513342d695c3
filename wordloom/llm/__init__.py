"""Operators for preparing large training corpora with Spark.

Nothing else in the library imports this subpackage.
"""
