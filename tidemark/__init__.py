"""Spark-native analytics for event, schedule and transit data, and corpus preparation."""
