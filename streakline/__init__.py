"""streakline: a Spark-native analytics engine for stacks of measurement images and tables."""

__version__ = "0.1.0"
