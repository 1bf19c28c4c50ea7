"""Spark-native analytics over bibliographic corpora, property graphs and text."""
