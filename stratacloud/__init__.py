"""A Spark-native engine for hierarchical point clouds with levels of detail."""
