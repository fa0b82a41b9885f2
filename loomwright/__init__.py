"""Attempt, text and retrieval analytics as Spark plans."""
