"""termweave: Spark-native analytics over sequences, annotations, ontologies and graphs."""

__version__ = "0.1.0"
