"""foliant: a Spark-native engine for document retrieval and corpus analysis."""

__version__ = "0.1.0"
