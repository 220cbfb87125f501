"""A Spark-native analytics engine for multi-asset bars, with operators for text corpora beside it."""
