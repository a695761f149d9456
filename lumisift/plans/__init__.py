"""Compositions of operators, and plan-shaping helpers."""
