"""Brightloom: a Spark-native analytics engine for generative-model evaluation studies."""
