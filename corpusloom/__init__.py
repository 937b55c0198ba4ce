"""corpusloom: a Spark-native analytics engine for source corpora."""

__version__ = "0.1.0"
