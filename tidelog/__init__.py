"""tidelog: a Spark-native engine for versioned key-value data, its indexes and its upkeep."""

__version__ = "0.1.0"
