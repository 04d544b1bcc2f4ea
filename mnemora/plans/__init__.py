"""Fixture projections and the registered queries with their SQL."""
