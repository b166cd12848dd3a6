"""Composed plans and the query / oracle registry."""
