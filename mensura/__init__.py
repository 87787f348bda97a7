"""Mensura: a Spark-native engine for indoor measurement data."""
