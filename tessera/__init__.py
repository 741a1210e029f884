"""tessera: Spark-native annotation, evaluation and tracking analytics."""
