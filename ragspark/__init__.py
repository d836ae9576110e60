"""PySpark jobs for the data side of retrieval-augmented generation."""

__version__ = "0.1.0"
