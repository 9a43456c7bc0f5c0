"""A Spark-native engine for evaluating document extraction."""
