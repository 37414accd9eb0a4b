"""Derived inputs and the query registry."""
