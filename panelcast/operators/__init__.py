"""Operators: feature transformers, split, ordered (skew-safe) windows, models, metrics."""
