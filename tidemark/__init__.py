"""tidemark: a Spark-native analytics toolkit (DataFrame, SQL and Structured Streaming)."""

__version__ = "0.1.0"
