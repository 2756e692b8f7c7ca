"""Question-bank analytics on Spark: document structure, review merge, export and roll-ups."""

__version__ = "0.1.0"
