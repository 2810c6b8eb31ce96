"""Prometheus-style metric samples on Spark, and operators for training data."""
