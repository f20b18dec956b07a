"""Transcript evidence, scoring and evaluation as Spark DataFrame operators."""
