"""Spark-native pseudonymization of diagnostic data."""
