"""Scalar functions: text, patterns, taxonomy, coercion and JSON."""
