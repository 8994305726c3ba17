"""A PySpark-native engine for 3D scene and tileset data."""

__version__ = "0.1.0"
