"""Complementarity analytics for knowledge-graph and dense-vector predictors on PySpark."""

__version__ = "0.1.0"
