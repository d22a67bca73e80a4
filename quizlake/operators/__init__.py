"""Operators: DataFrame -> DataFrame functions, one per reference behaviour."""
