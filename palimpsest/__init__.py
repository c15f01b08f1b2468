"""A Spark-native memory and evidence analytics engine."""
