"""Spark-native analytics for question corpora, practice events and training text."""
