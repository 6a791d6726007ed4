"""Classifiers and regressors as ``pyspark.ml`` pipelines from raw columns to predictions."""
