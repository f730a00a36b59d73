"""A Spark-native engine for spatial, feature-matching and pose-graph analytics."""
