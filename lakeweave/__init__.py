"""lakeweave: a Spark-native entity-resolution and record-linkage engine."""

__version__ = "0.1.0"
