"""Significance-plane analytics on Spark."""
