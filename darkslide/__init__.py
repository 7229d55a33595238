"""darkslide: a PySpark-native analytics library for large photo catalogues."""
