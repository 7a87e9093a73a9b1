"""Foliant: document grounding and catalog analytics as Spark DataFrame jobs."""
