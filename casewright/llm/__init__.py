"""Operators for preparing training data, each built on Spark's partitioning and shuffles."""
