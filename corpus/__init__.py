"""Turns the driver's ``documents`` table into source trees, with known answers."""
