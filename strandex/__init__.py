"""strandex: a PySpark-native analytics engine for catalogues of described, embedded and scored items."""

__version__ = "0.1.0"
