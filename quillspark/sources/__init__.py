"""Scans (A1-A6, A13, A16) and sinks."""
