"""Retrieval-based multi-label document coding, and its audit, as Spark plans."""
