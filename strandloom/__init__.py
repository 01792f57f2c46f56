"""PySpark-native analytics for biological sequences, annotations and text corpora."""

__version__ = "0.1.0"
