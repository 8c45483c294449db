"""Spark-native documentation-gap analytics over technical artifacts."""
