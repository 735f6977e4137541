"""Spark-native analytics over linked media, opinion and statistics tables."""
