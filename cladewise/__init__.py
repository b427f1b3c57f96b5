"""Lineage-recording analytics expressed as Spark DataFrame jobs."""
