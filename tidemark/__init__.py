"""Tidemark: a PySpark-native engine for quantitative research over time-stamped panels."""
