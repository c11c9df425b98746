"""Strandline: read-set analytics on Spark."""
