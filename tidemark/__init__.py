"""tidemark: Spark-native analytics over dated document streams."""
