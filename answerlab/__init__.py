"""Stability and quality measures for model answers, as Spark DataFrame operations."""
