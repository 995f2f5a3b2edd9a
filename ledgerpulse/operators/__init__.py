"""Operators: DataFrame in, DataFrame out, nothing collected unless the name says fit or train."""
