"""Queries assembled from the operators, and the SQL that states the same result."""
