"""Spark-native analytics for wide-vector observation data and metric logs."""
