"""Spark-native engine for prompt text, ordered lists, frame sequences and latent vectors."""
