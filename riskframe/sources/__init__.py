"""Readers, sinks and fixture bindings."""
