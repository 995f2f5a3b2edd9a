"""Compositions of operators: whole analysis runs and the query catalogue."""
