"""Compositions, derived tables and registered queries."""
