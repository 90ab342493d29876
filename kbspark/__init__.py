"""Spark-native knowledge-base analytics: every operator is DataFrame(s) + parameters -> DataFrame."""
