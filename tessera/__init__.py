"""Spark-native analytics engine for ensemble risk, verification and time-series queries."""
