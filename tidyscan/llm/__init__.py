"""Operators of a training-data pipeline: one module for each, and ``queries`` that apply them to the given tables."""
