"""Whole plans: the batch pipeline, and the catalogue of queries on the test tables."""
