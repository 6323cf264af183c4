"""tenderlake: a Spark-native engine for procurement-watch data."""
