"""Scoring short written answers against their source passages, as Spark jobs."""
