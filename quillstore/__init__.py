"""Spark-native analytics over stores of small typed knowledge documents."""
