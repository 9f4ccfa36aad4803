"""Spark-native product-catalog, store-registry and order analytics."""
