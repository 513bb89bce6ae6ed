"""Spark-native locus and variant analytics."""
