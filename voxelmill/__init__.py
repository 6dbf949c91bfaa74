"""Imaging metadata and quality analytics as Spark DataFrame jobs."""
