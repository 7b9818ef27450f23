"""A PySpark-native engine that checks, repairs and prepares text corpora."""

__version__ = "0.1.0"
