"""Spark-native checking and scoring of solutions of large sparse linear systems."""
