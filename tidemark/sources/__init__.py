"""Readers, schemas, sinks and table reports."""
