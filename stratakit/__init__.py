"""A PySpark-native analytics engine for document collections and the knowledge drawn from them."""

__version__ = "0.1.0"
