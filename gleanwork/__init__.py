"""Spark jobs that build and measure text retrieval, and the data work around it."""
