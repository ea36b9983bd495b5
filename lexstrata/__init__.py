"""lexstrata: a PySpark-native analytics engine for large multilingual text corpora."""

__version__ = "0.1.0"
