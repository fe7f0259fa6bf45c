"""A Spark-native engine that reconciles facts across document collections."""
