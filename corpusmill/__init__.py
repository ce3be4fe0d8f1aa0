"""Spark-native engine for building, curating and measuring instruction-tuning datasets."""
