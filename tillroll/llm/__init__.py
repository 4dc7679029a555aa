"""Operators for building text and vector training corpora on Spark."""
