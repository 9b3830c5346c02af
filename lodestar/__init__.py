"""lodestar: a Spark-first engine for requirement records and large text corpora."""

__all__ = ["runtime"]
