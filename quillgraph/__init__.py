"""A Spark-native engine for compressing, sampling and aggregating graph-attached feature vectors."""
