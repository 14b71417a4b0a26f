"""Spark-native analytics over annotated text, graphs and evaluation runs."""
