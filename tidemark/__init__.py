"""Growth and marketing analytics as lazy PySpark operators."""

__version__ = "0.1.0"
