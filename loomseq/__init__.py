"""loomseq: Spark-native analytics for noisy long-read amplicon data."""
