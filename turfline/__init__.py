"""A Spark-native engine for event cards: point-in-time histories, ratings, in-race statistics and feature selection."""
