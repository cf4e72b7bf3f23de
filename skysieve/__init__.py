"""Spark-native analytics for air quality, hotspots and transport."""
