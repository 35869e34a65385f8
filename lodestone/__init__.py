"""Spark-native engine for searching and analysing collections of source code and documents."""

__version__ = "0.1.0"
