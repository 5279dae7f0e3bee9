"""Scans of recording files into domain tables, and the sinks of these."""
