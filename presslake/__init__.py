"""presslake: Spark-native analytics for article feeds and their impression logs."""
