"""Spark-native analytics for checking spoken claims against written documents."""
