"""Column functions used by the parsers, detectors and commands."""
