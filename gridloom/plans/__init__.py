"""Whole runs and the catalog of registered queries."""
