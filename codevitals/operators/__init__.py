"""The six detectors: plans from files and symbols to findings."""
