"""quorate: Spark-native analytics for judging competing answers to the same cases."""

__version__ = "0.1.0"
