"""Spark-native engine for influence networks, activity time series and corpus preparation."""
