"""Scans, sinks, tables and the catalog."""
