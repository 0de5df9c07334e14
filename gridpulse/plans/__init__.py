"""Whole pipelines and report queries built from the operators."""
