"""Operators for preparing language-model training data, written as Spark jobs.

Nothing outside this folder imports it.
"""
