"""Composed plans: the multi-horizon forecast and its reports."""
