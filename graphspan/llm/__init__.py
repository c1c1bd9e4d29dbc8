"""Operators for preparing language-model training data on Spark.

Self-contained: nothing else in the library imports this subpackage.
"""
