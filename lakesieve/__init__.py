"""A Spark-native engine that filters, assembles, packs and measures large text corpora."""
