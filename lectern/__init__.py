"""Lectern: a PySpark-native engine for reviewing draft translations at scale."""

__version__ = "0.1.0"
