"""siftflow: a Spark-native pipe-language analytics engine for logs and events."""

__version__ = "0.1.0"
