"""Readers that project any source onto the panel schema, and the sinks."""
