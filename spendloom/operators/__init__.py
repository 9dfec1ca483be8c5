"""Operators on DataFrames: versions, scope, spend, anomalies, quality, retrieval, answers."""
