"""Dependency-graph analytics on PySpark."""
