"""Cordillera: a PySpark-native analytics engine for literature graphs, spatial cells and corpora."""
