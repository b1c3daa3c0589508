"""Rubric-based assessment of long documents, expressed as Spark plans."""
