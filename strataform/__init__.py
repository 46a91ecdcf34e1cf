"""Spark-native document analytics: extraction records, scoring, and cleaning of scientific text."""
