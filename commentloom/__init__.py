"""Spark-native analysis of open-ended survey comments in many languages."""

__all__ = ["config", "functions", "operators", "plans", "sources", "streaming"]
