"""Composed jobs and the catalogue of registered queries."""
