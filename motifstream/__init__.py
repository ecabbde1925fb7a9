"""Incremental subgraph matching on Spark, and operators for training data."""
