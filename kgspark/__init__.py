"""kgspark: Spark-first analytics over linked document collections."""

__version__ = "0.1.0"
