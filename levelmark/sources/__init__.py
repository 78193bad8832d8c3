"""Scans, sinks, file listings and profiles."""
