"""twotier: Spark-native two-layer anomaly-detection analytics."""

__version__ = "0.1.0"
