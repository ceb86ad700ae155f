"""Spark-native detection, rewriting and scoring of personal data in text tables."""
