"""Loomline: a PySpark-native engine for conversation analytics and training-data preparation."""
