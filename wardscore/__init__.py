"""Composite area indices from messy public records, as PySpark DataFrame jobs."""
