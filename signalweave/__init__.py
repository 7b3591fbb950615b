"""PySpark-native analytics over dated publications and training corpora."""

__version__ = "0.1.0"
