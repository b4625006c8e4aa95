"""Millrace: a Spark-native decision-support engine."""
