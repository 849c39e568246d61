"""sparkdex: a Spark-native multi-index query engine."""
