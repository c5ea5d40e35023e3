"""Spark-native analytics over signal, bitstream and packet tables."""
