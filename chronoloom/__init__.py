"""Spark-native interval, text and corpus analytics."""
