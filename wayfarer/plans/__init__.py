"""Fixtures over the test tables and the catalogue of queries."""
