"""Spark-native change analytics for multi-epoch point clouds and tables of documents."""
