"""Spark-native analytics for stacks of detector frames."""
