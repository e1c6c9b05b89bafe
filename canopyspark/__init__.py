"""Spark-native change analytics over raster relations, with DataFrame operators only."""
