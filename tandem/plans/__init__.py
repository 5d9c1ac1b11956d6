"""Fixtures, reports and the query register."""
