"""basalt: a Spark-native multi-model analytics engine."""

__version__ = "0.1.0"
