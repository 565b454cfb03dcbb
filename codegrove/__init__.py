"""A PySpark-native engine for structural code graphs and training corpora."""
