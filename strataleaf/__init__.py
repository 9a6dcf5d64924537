"""strataleaf: Spark-native analytics over versioned, cited documents."""

__version__ = "0.1.0"
