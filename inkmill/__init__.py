"""Spark-native analytics over document collections and the knowledge graphs derived from them."""
