"""Whole-project plans built from sources, parsers and detectors."""
