"""Spark-native operators for moving statistical-language data estates onto Spark."""
