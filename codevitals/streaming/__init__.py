"""Continuous re-scan of changing files."""
