"""Spark-native private record linkage: feature strings, Bloom filters, soft-cosine comparison and one-to-one matching."""

__version__ = "0.1.0"
