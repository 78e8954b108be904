"""Whole pipelines assembled from functions and operators, and the query catalogue."""
