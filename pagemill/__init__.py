"""Spark-native document-dataflow analytics: typed DataFrames in, DataFrames out."""
