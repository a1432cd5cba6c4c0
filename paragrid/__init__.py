"""Spark-native document analytics: parsing results, corpora, retrieval and evaluation as DataFrames."""
