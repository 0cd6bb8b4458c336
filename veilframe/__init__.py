"""veilframe: Spark-native de-identification of annotated documents, with proof and metrics."""
