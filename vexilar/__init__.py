"""vexilar: a Spark-first engine for open-set signal analytics and training-data preparation."""

__version__ = "0.1.0"
