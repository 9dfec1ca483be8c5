"""Spark-native spending analytics and corpus preparation."""
