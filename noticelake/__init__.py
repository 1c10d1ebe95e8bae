"""noticelake: Spark-native analytics for evidence-based observation pipelines."""
