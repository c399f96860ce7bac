"""palimpsest: a Spark-native engine for measuring what text canonicalization does to a classifier."""
