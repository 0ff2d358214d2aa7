"""Scans, table adapters and sinks."""
