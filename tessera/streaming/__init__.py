"""Windowed counts and trend detection, as streams and as batch twins of equal results."""
