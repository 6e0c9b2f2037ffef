"""Spark-native raster change detection and seasonal envelope analytics."""
