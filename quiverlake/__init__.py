"""A Spark-native vector collection engine."""
