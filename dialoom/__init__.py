"""Dialoom: Spark-native analytics over time-ordered, speaker-labelled conversations."""
