"""Spark-native comparative panel analytics."""
