"""Spark-native analytics for elevation rasters, point sets, triangulated meshes and map tiles."""

__version__ = "0.1.0"
