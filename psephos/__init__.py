"""psephos: Spark-native analytics for polling-station results."""
