"""Operators for preparing training text at scale."""
