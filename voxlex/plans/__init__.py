"""Composed analyses (survey I1-I9) and the query registry."""
