"""shelfspark: a Spark-native engine for multimodal asset retrieval and asset analytics."""
