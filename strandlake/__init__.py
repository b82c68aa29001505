"""Strandlake: PySpark-native operators for ordered numeric data, state sequences and event logs."""

__version__ = "0.1.0"
