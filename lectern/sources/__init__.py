"""Readers, connectors and the table store."""
