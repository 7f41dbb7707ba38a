"""Lakehouse operators for PySpark: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
