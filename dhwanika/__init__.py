"""dhwanika: Spark-native analytics for noisy multilingual transcripts and their audio segments."""

__version__ = "0.1.0"
