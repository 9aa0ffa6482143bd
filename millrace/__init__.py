"""millrace: a Spark-native analytics and data-mining engine for streams of short, messy records."""

__version__ = "0.1.0"
