"""lodepath: Spark-native analytics for indoor-positioning data."""
