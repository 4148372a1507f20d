"""A Spark-native engine for rollouts, scores, embeddings, evolving programs and their lineage."""
