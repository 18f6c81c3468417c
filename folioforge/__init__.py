"""Spark-native document extraction, evidence scoring and evaluation."""
